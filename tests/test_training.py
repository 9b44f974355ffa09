"""Training and evaluation operators against plain Python, on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import evaluation, training
from weftline.sources import files, lines

LONGS = "src long, dst long"


def test_noise_is_the_smoothed_distribution(spark):
    counts = {i: i * i + 1 for i in range(40)}
    got = {r["id"]: (r["low"], r["high"]) for r in training.noise(spark.createDataFrame(list(counts.items()), "id long, cn long")).collect()}
    total = sum(c**0.75 for c in counts.values())
    assert all(math.isclose(got[i][1] - got[i][0], c**0.75 / total, abs_tol=1e-9) for i, c in counts.items())
    spans = sorted(got.values())
    assert spans[0][0] == 0 and math.isclose(spans[-1][1], 1) and all(math.isclose(a[1], b[0], abs_tol=1e-9) for a, b in zip(spans, spans[1:]))


def test_negatives_follow_the_noise_and_come_again(spark):
    pairs = spark.createDataFrame([(i, 1000 + i % 7) for i in range(600)], LONGS)
    noise = training.noise(spark.createDataFrame([(1000 + k, 1 + 50 * (k == 3)) for k in range(7)], "id long, cn long"))
    rows = [tuple(r) for r in training.with_negatives(pairs, noise, 5, 1).collect()]
    again = [tuple(r) for r in training.with_negatives(pairs.repartition(5), noise, 5, 1).collect()]
    assert sorted(rows) == sorted(again) and sum(y == 1 for *_, y in rows) == 600
    drawn = [d for _, d, y in rows if y == 0]
    assert 0.6 < drawn.count(1003) / len(drawn) < 0.85 and all(y or d != 1000 + s % 7 for s, d, y in rows)


@pytest.mark.parametrize("mode", training.MODES)
def test_epochs_lower_the_loss_and_leave_snapshots(spark, tmp_path, mode):
    pairs = spark.createDataFrame([(i, 100 + i % 3) for i in range(30)], LONGS)
    ids = spark.createDataFrame([(i,) for i in [*range(30), 100, 101, 102]], "id long")
    noise = training.noise(spark.createDataFrame([(100 + k, 10) for k in range(3)], "id long, cn long"))
    config = training.Config(dim=4, alpha={"sgd": 5.0, "adadelta": 1.0, "adam": 0.03}.get(mode, 0.3), clip=0, negatives=2, mode=mode)
    vectors, losses = training.train(pairs, training.initial(ids, 4), config, noise, str(tmp_path), 4, seed=3)
    assert len(losses) == 4 and vectors.count() == 33 and spark.read.parquet(str(tmp_path / "epoch-2")).count() == 33
    if mode != "adadelta":  # its steps begin at the smallest size
        assert losses[-1] < losses[0]
    _, early = training.train(pairs, training.initial(ids, 4), config, noise, str(tmp_path / "early"), 4, budget=31)
    assert len(early) == 2


def test_skipgram_gradient_is_that_of_finite_differences(spark):
    draw = np.random.default_rng(4)
    v = {i: (draw.normal(0, 1, 3), draw.normal(0, 1, 3)) for i in range(4)}
    pairs = [(0, 1, 1), (0, 2, 0), (3, 1, 0)]
    zero = [0.0] * 3
    frame = spark.createDataFrame([(i, a.tolist(), b.tolist(), zero, zero, zero, zero) for i, (a, b) in v.items()], "id long, vec array<double>, out array<double>, vec1 array<double>, vec2 array<double>, out1 array<double>, out2 array<double>")
    _, sums = training.train_step(spark.createDataFrame(pairs, LONGS + ", label int"), frame, training.Config(dim=3))
    got = {(r["side"], r["id"]): r["g"] for r in sums.collect()}

    def loss(w):
        return -sum(math.log(1 / (1 + math.exp(-(2 * y - 1) * float(w[s][0] @ w[d][1])))) for s, d, y in pairs)

    for (side, i), g in got.items():
        for k in range(3):
            up, down = ({j: (a.copy(), b.copy()) for j, (a, b) in v.items()} for _ in range(2))
            up[i][side == "out"][k] += 1e-5
            down[i][side == "out"][k] -= 1e-5
            assert math.isclose(g[k], -(loss(up) - loss(down)) / 2e-5, rel_tol=1e-4, abs_tol=1e-6)


def test_dimensions_must_agree(spark):
    one, two = (spark.createDataFrame([(1, [0.0] * n)], "id long, vec array<double>") for n in (2, 3))
    assert evaluation.same_dimension([one, one]) == 2
    with pytest.raises(ValueError):
        evaluation.same_dimension([one, two])


def test_senses_weigh_by_context(spark):
    rows = [(1, 1, 10, 0.9, [1.0, 0.0]), (1, 1, 11, 0.1, [0.0, 1.0]), (1, 2, 20, 1.0, [1.0, 0.0]), (2, 1, 10, 1.0, [1.0, 0.0])]
    got = evaluation.sense_similarity(spark.createDataFrame(rows, "pair long, side int, sense long, weight double, vec array<double>")).collect()
    assert len(got) == 1 and math.isclose(got[0]["avg_sim"], 0.9 * 1 + 0.1 * 0.5) and got[0]["max_sim"] == 1


def test_output_files_fill_up_in_order(spark):
    rows = spark.createDataFrame([(k, 300) for k in range(1, 41)], "k long, size long")
    got = {r["k"]: (r["before"], r["path"]) for r in files.output_files(rows, "k", "size", 1000, 2).collect()}
    assert got[1] == (0, "AA/wiki_00") and got[5] == (1200, "AA/wiki_01") and got[8][1] == "AB/wiki_00" and got[40][0] == 39 * 300
    totals = {r["k"]: r["before"] for r in files.running_totals(rows, "k", "size", 7).collect()}
    assert totals == {k: 300 * (k - 1) for k in range(1, 41)}


def test_xml_segments_skip_tags_and_times(spark):
    seg = lambda n, x: f'<SEG start_char="{n}"><ORIGINAL_TEXT>{x}</ORIGINAL_TEXT></SEG>'
    whole = "<DOC><TEXT>" + seg(40, "one &amp; two") + seg(60, "&lt;p&gt;") + seg(70, "Time: 3") + "</TEXT></DOC>"
    got = lines.kbp_xml(spark.createDataFrame([("d", whole), ("e", "<DOC/>"), ("f", None)], "doc string, value string")).collect()
    assert [tuple(r) for r in got] == [("d", 0, "one & two")]


def test_recycled_counts_on(spark):
    got = training.recycled(spark.range(3).withColumnRenamed("id", "k").withColumn("x", F.col("k") * 10), 3, 8).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(k, k % 3 * 10) for k in range(8)]


def test_draws_meet_few_rows_whatever_the_number_of_ids(spark):
    """A cell of the distribution holds about one id, and draws don't depend on the number of cells."""
    n = 20_000
    assert training.noise_cells(n) >= n and training.noise_cells(n) & (training.noise_cells(n) - 1) == 0
    pairs = spark.createDataFrame([(i, i + 1) for i in range(300)], LONGS)
    noise = training.noise(spark.range(n).select("id", (F.col("id") % 9 + 1).alias("cn"))).localCheckpoint()
    one, two = (sorted(tuple(r) for r in training.with_negatives(pairs, noise, 3, 1, cells).collect()) for cells in (None, 64))
    assert one == two and len(one) > 1100


def test_batches_without_a_side_are_updated_too(spark):
    """Ids that are never a source, or never a target, fill batches of their own."""
    ids = spark.range(6)
    noise = training.noise(spark.createDataFrame([(4, 1), (5, 1)], "id long, cn long"))
    pairs = training.with_negatives(spark.createDataFrame([(0, 4), (1, 5)], LONGS), noise, 1, 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        new, sums = training.train_step(pairs, training.initial(ids, 3).coalesce(1), training.Config(dim=3))
        assert new.count() == 6 and sums.where("side = 'vec'").count() == 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
