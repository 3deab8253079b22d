import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.operators import linking as L

KIND = "kind string, id string, label string, commodity string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_names_against_all_labels(spark):
    labels = ["copper", "iron", "rare earth elements", "gold", "zinc", "tin", "silver", "manganese", "%"]
    names = ["opper", "kopper", "rare earth elem", "ron", "irn", "old", "tun", "xilver", "anganese", "mangan", "coper ore", "", "z", "copper"]
    r = np.random.default_rng(1)
    for label in labels * 12:  # some letters taken out, put in or changed
        own = list(label)
        for _ in range(r.integers(1, 5)):
            at = r.integers(0, len(own) + 1)
            own[at : at + r.integers(0, 2)] = list("abcz"[: r.integers(0, 2)])
        names.append("".join(own).strip())
    want = set()
    for name in set(names):
        near = {(name, x, 1 - distance(name, x) / max(len(name), len(x))) for x in labels}
        want |= {x for x in near if x[2] == 1} or {x for x in near if x[2] >= 0.75}
    known = spark.createDataFrame([("commodity", x, x, None) for x in labels], KIND)
    got = L.link_names(spark.createDataFrame([(x,) for x in names], "name string"), known).collect()
    rounded = lambda rows: sorted((a, b, round(c, 9)) for a, b, c in rows)
    assert rounded((x.name, x.id, x.score) for x in got) == rounded(want)
    assert {("opper", "copper"), ("kopper", "copper"), ("ron", "iron"), ("rare earth elem", "rare earth elements")} <= {(x.name, x.id) for x in got}


def test_text_ordinals_of_alike_texts(spark):
    """One long common beginning, repeated texts, nulls: numbered as a sort would."""
    from strataform.operators.ranking import text_ordinals

    rows = [(i, None if i % 97 == 0 else "http://the/same/" + str(i * 7919 % 400).zfill(3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, name string").repartition(5)
    got = {r.id: r.ordinal for r in text_ordinals(df, "name", "id").collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0])))}
    sizes = [r["count"] for r in text_ordinals(df.withColumn("name", F.lit("one")), "name", "id").groupBy("name").count().collect()]
    assert sizes == [3000] and text_ordinals(df.limit(0), "name", "id").count() == 0


def test_most_similar_of_whole_catalogues(spark):
    from strataform.functions.text import levenshtein_similarity
    from strataform.operators.joins import most_similar

    cells = spark.createDataFrame([(w,) for w in ["copper", "copper ore", "tin", " ", "zinc", "zinc"]], "value string")
    catalogue = spark.createDataFrame([("a", i, w) for i, w in enumerate(["coper", "tinn", "lead", "zink", "coper", "", None])] + [("b", 1, "copper ores")], "label string, pos int, value string")
    for least in (0.0, 0.7):
        got = {(r.label, r.pos): (r.value, round(r.similarity, 9)) for r in most_similar(catalogue, cells, 3, least).collect()}
        pairs = catalogue.crossJoin(cells.where("trim(value) <> ''").withColumnRenamed("value", "cell")).withColumn("s", levenshtein_similarity(F.col("value"), F.col("cell")))
        best = {}
        for r in pairs.where(f"s >= {least}").groupBy("label", "pos", "value").agg(F.max("s").alias("s")).collect():
            best.setdefault(r.label, []).append((-r.s, r.pos, r.value))
        want = {(label, pos): (value, round(-s, 9)) for label, xs in best.items() for s, pos, value in sorted(xs)[:3]}
        assert got == want


def test_few_refuses_many(spark, monkeypatch):
    from strataform.operators import labelling

    monkeypatch.setattr(labelling, "LABELLED", 5)
    assert labelling.few(spark.range(5), "labels").count() == 5
    with pytest.raises(ValueError, match="over 5 labels"):
        labelling.few(spark.range(6), "labels")
