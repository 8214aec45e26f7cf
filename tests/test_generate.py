"""Generators G1-G3: determinism, shapes and the published grid."""

from collections import Counter

from pyspark.sql import functions as F

from samplesmith.operators import generate as G


def test_template_grid_deterministic_and_valid(spark):
    ids = spark.range(3000)
    a = G.template_grid(ids, "id")
    b = G.template_grid(ids.repartition(7), "id")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    rows = a.collect()
    valid = {t.replace("{task}", task) for _, t, tasks in G.CATEGORIES for task in tasks}
    assert all(r.instruction in valid for r in rows)
    cats = Counter(r.category for r in rows)
    # category first (12 uniform picks), then a task: python has 4 of the 12 categories
    assert abs(cats["python"] / 3000 - 4 / 12) < 0.05
    py = [r for r in rows if r.category == "python"]
    assert all(r.input.startswith("# ") and r.output == "# Implementation here\n" for r in py)
    assert all(len(r.input) <= 500 for r in rows)


def test_example_bank(spark):
    rows = G.example_bank(spark.range(2000), "id").collect()
    seen = Counter(r.instruction for r in rows)
    assert set(seen) == {e[0] for e in G.EXAMPLE_BANK}
    assert min(seen.values()) > 120


def test_variant_samples(spark):
    df = G.variant_samples(spark)
    rows = df.orderBy("seq").collect()
    assert len(rows) == 300 and [r.seq for r in rows] == list(range(300))
    first, second = rows[0], rows[1]
    assert first.input == G.VARIANT_PROMPTS[0][1]
    assert second.input == "def reverstre_strtrinumg(str):\n    returnum str[::-1]"
    assert rows[-1].output == "Correct Rust code."
    assert df.where(F.col("instruction").startswith("Write a function in ")).count() == 120
