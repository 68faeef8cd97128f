import numpy as np
from pyspark.sql import functions as F

from quillmill.llm import images


def picture(seed):
    r = np.random.default_rng(seed)
    a = np.full((96, 96), 120.0)
    for _ in range(26):
        x, y = r.integers(0, 84, 2)
        w, h = r.integers(5, 26, 2)
        a[y : y + h, x : x + w] += r.integers(-70, 70)
    return np.clip(a, 0, 255)


def test_edited_and_cropped_copies_are_found(spark):
    r = np.random.default_rng(1)
    rows = [(i, images.write_pgm(picture(i))) for i in range(12)]
    rows += [(100 + i, images.write_pgm(np.clip(picture(i) * 0.85 + 12 + r.normal(0, 2, (96, 96)), 0, 255))) for i in range(6)]
    rows += [(200 + i, images.write_pgm(picture(i)[5:91, 8:94])) for i in range(6)]
    rows += [(300 + i, images.write_pgm(np.rot90(picture(i)))) for i in range(3)]
    rows += [(400 + i, images.write_pgm(picture(3))) for i in range(40)]
    rows += [(900, None), (901, b""), (902, b"P5 9"), (903, images.write_pgm(np.zeros((64, 64)))), (904, images.write_pgm(np.zeros((3, 3))))]
    frame = spark.createDataFrame(rows, "id long, image binary")
    got = {x["id"]: x for x in images.classes(frame).collect()}
    assert len(got) == len(rows)
    want = {i: i % 100 if i < 400 else 3 if i < 900 else i for i, _ in rows}
    wrong = [i for i in want if got[i]["component_id"] != want[i]]
    assert len(wrong) <= 2, wrong
    assert all(got[i]["n_points"] == 0 for i in range(900, 905))


def test_rendered_table(spark, sf):
    rows = images.op1_images(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert images.classes(spark.createDataFrame([], "id long, image binary")).count() == 0


def scene(seed, side):
    r = np.random.default_rng(seed)
    a = np.full((side, side), 120.0)
    for _ in range(26 * side * side // 96**2):
        x, y = r.integers(0, side - 12, 2)
        w, h = r.integers(5, 26, 2)
        a[y : y + h, x : x + w] += r.integers(-70, 70)
    return np.clip(a, 0, 255)


def test_crops_of_large_images_are_found(spark):
    """Parts of half and a quarter of the area, by the whole operator; strangers stay apart."""
    rows, want = [], {}
    for side, shares in ((96, (0.5,)), (192, (0.5, 0.25)), (384, (0.5, 0.25))):
        for k in range(8):
            a, own = scene(1000 * side + k, side), side * 100 + 10 * k
            rows.append((own, images.write_pgm(a)))
            for j, share in enumerate(shares, start=1):
                part, r = int(side * share**0.5), np.random.default_rng(side + 10 * k + j)
                x, y = r.integers(0, side - part + 1, 2)
                rows.append((own + j, images.write_pgm(a[y : y + part, x : x + part])))
                want[own + j] = own
    got = {x["id"]: x["component_id"] for x in images.classes(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert sum(got[i] == o for i, o in want.items()) >= 0.9 * len(want)
    assert all(got[o] == o for o in want.values())


def test_every_pair_left_in_a_large_bucket_is_taken(spark):
    """No image of a bucket is compared with leaders only: all pairs of two components meet, each once."""
    parts = {i: i % 3 for i in range(700)} | {i: i for i in range(700, 720)}
    listed = spark.createDataFrame([("k", (i,)) for i in parts] + [("same", (i,)) for i in range(0, 300, 3)], "key string, p struct<id:long>")
    found = spark.createDataFrame([(i, c) for i, c in parts.items() if i < 700], "id long, component_id long")
    got = images.apart(listed, found).selectExpr("a.id as u", "b.id as v").toPandas()
    want = sum(parts[i] != parts[j] for i in parts for j in parts if i < j)
    assert len(got) == want and not got.duplicated().any() and (got["u"] < got["v"]).all()
    assert all(parts[u] != parts[v] for u, v in got.itertuples(index=False))


def test_last_round_takes_the_pairs_that_rows_would(spark, monkeypatch):
    """Groups that meet in a task give the links that a row a match gives, with no such row."""
    r = np.random.default_rng(5)
    rows = [(i * 3 % 97, images.write_pgm(picture(i % 9) * r.uniform(0.8, 1) + r.normal(0, 3, (96, 96)) + r.integers(0, 25))) for i in range(40)]
    rows += [(1000 + i, images.write_pgm(np.rot90(picture(i % 9)[4:90, 6:92], k=i % 4))) for i in range(9)]
    frame = spark.createDataFrame(rows, "id long, image binary")
    chunk = [F.conv(F.hex(F.substring("d", 4 * k + 1, 4)), 16, 10).cast("long").alias(f"c{k}") for k in range(images.BITS // 32)]
    points = images.descriptors(frame).select("id", "x", "y", "turn", "scale", "of", *chunk).cache()
    point = F.struct(*points.columns)
    listed = points.select(F.explode(F.array(*[F.struct(F.lit(k).alias("chunk"), F.col(f"c{k}").alias("value")) for k in range(4)])).alias("key"), point.alias("p"))
    found = spark.createDataFrame([(3, 0), (6, 0), (30, 0), (9, 6), (1003, 9)], "id long, component_id long")
    want = {tuple(x) for x in images.copies(images.apart(listed, found)).collect()}
    own = points.join(found, "id", "left").withColumn("c", F.coalesce("component_id", "id")).toPandas()
    points.unpersist()
    every = {f: own[f].to_numpy(dtype=np.int64) for f in images._FIELDS}
    one, two = ({f: x[every["id"] % 2 == k] for f, x in every.items()} for k in (0, 1))
    for stride, held in ((1 << 18, 1 << 21), (7, 100)):
        monkeypatch.setattr(images, "STRIDE", stride)
        monkeypatch.setattr(images, "HELD", held)
        pairs = lambda a, b, same: {(int(u), int(v)) for us, vs in images.links(a, b, same) for u, v in zip(us, vs, strict=True)}
        assert len(want) > 100 and pairs(every, every, True) == want
        assert pairs(one, one, True) | pairs(two, two, True) | pairs(one, two, False) == want
    monkeypatch.setattr(images, "GROUP", 150)
    forest = images.components(images.crossing(points, found)).collect()
    assert {tuple(x) for x in forest} == {tuple(x) for x in images.components(spark.createDataFrame(sorted(want), "u long, v long")).collect()}


def test_no_row_a_match_is_made_in_the_last_round(spark, monkeypatch):
    frame = spark.createDataFrame([(i, images.write_pgm(picture(i % 5) + i)) for i in range(20)] + [(99, None)], "id long, image binary")
    monkeypatch.setattr(images, "apart", None)
    got = {x["id"]: x["component_id"] for x in images.classes(frame).collect()}
    assert got == {i: i % 5 for i in range(20)} | {99: 99}
    assert images.crossing(images.descriptors(frame.where("id > 50")).selectExpr("*", *[f"0L c{k}" for k in range(4)]), spark.createDataFrame([], "id long, component_id long")).count() == 0
