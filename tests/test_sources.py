import numpy as np
import pytest

from tessera.functions import arrays, costs
from tessera.sources import images, records


def pictures():
    r = np.random.default_rng(3)
    gradient = np.zeros((8, 8, 3), np.uint8)
    for y in range(8):
        for x in range(8):
            gradient[y, x] = (32 * x, 32 * y, 16 * (x + y))
    yield "gradient", gradient
    yield "flat", np.full((5, 7, 3), 9, np.uint8)
    yield "noise", r.integers(0, 256, (13, 10, 3)).astype(np.uint8)
    yield "alpha", r.integers(0, 256, (9, 11, 4)).astype(np.uint8)
    yield "opaque", np.concatenate((np.full((3, 3, 1), 255, np.uint8), r.integers(0, 256, (3, 3, 3)).astype(np.uint8)), axis=2)


def argb(image):
    return image if image.shape[2] == 4 else np.concatenate((np.full((*image.shape[:2], 1), 255, np.uint8), image), axis=2)


@pytest.mark.parametrize("form", sorted(images.ENCODERS))
@pytest.mark.parametrize("name,image", list(pictures()), ids=lambda v: v if isinstance(v, str) else "")
def test_round_trip(form, name, image):
    assert (argb(images.decode(images.ENCODERS[form](image))) == argb(image)).all()


def test_packed_copies():
    window = bytearray(4096)
    out, at = images.unpacked(bytes([0b1000, 97, 98, 99, 0, 0]), 6, window, 0)
    assert out == b"abcabc" and at == 6


def test_images_from_files(spark, tmp_path):
    for name, image in pictures():
        for form, encode in images.ENCODERS.items():
            (tmp_path / f"{name}.{form}").write_bytes(encode(image))
    (tmp_path / "bad.bmp").write_bytes(b"BMxx")
    found = images.read_images(spark, str(tmp_path))
    assert found.where("error is not null").count() == 1
    assert found.where("error is null").count() == 20
    assert images.encoded(found, "png").count() == 20


def test_label_records(spark, tmp_path):
    body = b"".join(
        [
            records.pack_record([2, 3, 1, 2, 5, 1], [6, 2, 3, 1, 3, 0]),
            records.pack_record([0, 1, 2, 3, 7, 0], [1, 0, 1, 2, 6, 1]),
            records.pack_record([4, 5, 0, 1, 2, 1], None),
            records.pack_record([9, 0, 0, 0, 0, 0], None),
        ]
    )
    (tmp_path / "labels.bin").write_bytes(body)
    rows = records.read_label_records(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r["best_predictor"] for r in rows] == [2, 0, 4, 9]
    assert [r["second_reorder"] for r in rows] == [3, 6, None, None]
    assert [r["error"] for r in rows] == [None, None, None, "label out of range"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnope\n{"a": 2}\n')
    lenient = records.read_json_lines(spark, str(tmp_path), "a int", "lenient").orderBy("line_no").collect()
    assert [r["row"] and r["row"]["a"] for r in lenient] == [1, None, None, 2]
    assert [r["line_no"] for r in records.read_json_lines(spark, str(tmp_path), "a int", "skip").orderBy("line_no").collect()] == [0, 2, 3]
    with pytest.raises(Exception, match="line 2"):
        records.checked(records.read_json_lines(spark, str(tmp_path), "a int")).orderBy("line_no").collect()


def test_scan_orders_are_permutations():
    for order in arrays.scan_orders().values():
        assert sorted(order) == list(range(64))
    assert arrays.scan_orders()["hilbert"][:9] == [0, 8, 9, 1, 2, 3, 11, 10, 18]


# The scan orders that rules build, by place in the block.
HILBERT = [
    0, 8, 9, 1, 2, 3, 11, 10,
    18, 19, 27, 26, 25, 17, 16, 24,
    32, 33, 41, 40, 48, 56, 57, 49,
    50, 58, 59, 51, 43, 42, 34, 35,
    36, 37, 45, 44, 52, 60, 61, 53,
    54, 62, 63, 55, 47, 46, 38, 39,
    31, 23, 22, 30, 29, 28, 20, 21,
    13, 12, 4, 5, 6, 14, 15, 7,
]
DIAGONAL = [
    0, 1, 8, 16, 9, 2, 3, 10,
    17, 24, 32, 25, 18, 11, 4, 5,
    12, 19, 26, 33, 40, 48, 41, 34,
    27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36,
    29, 22, 15, 23, 30, 37, 44, 51,
    58, 59, 52, 45, 38, 31, 39, 46,
    53, 60, 61, 54, 47, 55, 62, 63,
]


def test_scan_orders_equal_the_fixed_tables():
    orders = arrays.scan_orders()
    mirror = lambda order: [order[y * 8 + 7 - x] for y in range(8) for x in range(8)]
    turned = lambda order: [order[x * 8 + y] for y in range(8) for x in range(8)]
    assert orders["hilbert"] == HILBERT and orders["diagonal"] == DIAGONAL and orders["antidiagonal"] == mirror(DIAGONAL)
    assert orders["horizontal"][:18] == [0, 1, 2, 3, 4, 5, 6, 7, 15, 14, 13, 12, 11, 10, 9, 8, 16, 17]
    assert orders["vertical"][:10] == [0, 8, 16, 24, 32, 40, 48, 56, 57, 49]
    assert orders["flat"] == turned(orders["steep"]) and orders["flat_up"] == [orders["steep"][x * 8 + 7 - y] for y in range(8) for x in range(8)]


def test_golomb_tables():
    assert len(costs.DEFAULT) == 8 and all(sum(c) == 1024 for _, _, c in costs.DEFAULT)
    assert len(costs.parse_golomb("# note\n" + "8 8 | 1024 0 0 0 0 0 0 0 0 ; x\n")) == 8
    with pytest.raises(ValueError, match="add up"):
        costs.parse_golomb("1 2 3 4 5 6 7 8 9")


def test_streaming_appends_new_files_once(spark, tmp_path):
    from tessera.streaming.incremental import append_new_files

    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"a": 1}\n{"a": 2}\n')
    go = lambda: append_new_files(spark, str(source), "a int", str(tmp_path / "out"), str(tmp_path / "cp"))
    go()
    (source / "2.json").write_text('{"a": 3}\n')
    go()
    assert sorted(r["a"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_eighth_generation_over_tiles_and_coders():
    from tessera.sources import gen8

    r = np.random.default_rng(9)
    tall = np.repeat(np.repeat(r.integers(0, 256, (24, 3, 3)), 4, axis=0), 4, axis=1).astype(np.uint8)[:, :11]
    assert (gen8.decode(gen8.encode(tall, [0, 3])) == tall).all()
    with pytest.raises(ValueError, match="early"):
        gen8.decode(gen8.encode(tall, [0])[:-40] + bytes(0))


def test_rows_of_both_coders():
    from tessera.functions.costs import DEFAULT
    from tessera.sources import gen8

    r = np.random.default_rng(1)
    for row in range(8):
        for scale in (1, 40, 3000):
            values = (r.integers(-scale, scale + 1, 300) * (r.random(300) < 0.6)).tolist()
            out = gen8.Bits()
            gen8.write_row(out, values, row, DEFAULT)
            assert gen8.read_row(gen8.Reader(out.bytes()), 300, row, DEFAULT) == values
    columns = [r.integers(0, m, 50).tolist() for m in (8, 96, 2, 2)] + [[1] * 50]
    out = gen8.Bits()
    gen8.write_settings(out, columns)
    assert gen8.read_settings(gen8.Reader(out.bytes()), 50) == columns
