"""Step plug-ins: cut anywhere, in batch or live, in any micro-batches; live detectors equal the batch ones."""

import io

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowstream.functions.drift import Adwin, Ddm
from flowstream.operators import drift as D
from flowstream.operators import learners as L
from flowstream.operators import scoring as S
from flowstream.operators import steps as P
from flowstream.operators.thresholds import DspotStep, dspot
from flowstream.plans.experiments import anomaly_experiment, classification_experiment
from flowstream.streaming import live as V
from flowstream.streaming import steps as X

START = 1_700_000_000


class Ewma:
    """A scorer that remembers order: a slow mean, refused for negative values."""

    def __init__(self):
        self.mean = None

    def score_instance(self, x):
        return None if self.mean is None else abs(x[0] - self.mean)

    def train(self, x):
        if x[0] < 0:
            raise ValueError("not learned")
        self.mean = x[0] if self.mean is None else 0.9 * self.mean + 0.1 * x[0]


class LastClass:
    last = None

    def predict(self, x):
        return self.last

    def train(self, x, y):
        self.last = y


def plain(rows):
    out, models = {}, {}
    for k, i, x, y in sorted(rows, key=lambda r: r[1]):
        scorer, classes = models.setdefault(k, (Ewma(), LastClass()))
        score, pred = scorer.score_instance([x]), classes.predict([x])
        out[(k, i)] = (score, pred or 0)
        try:
            scorer.train([x])
        except ValueError:
            pass
        if y is not None:
            classes.train([x], y)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    got = []
    for k in ("a", "b", None):
        x = rng.normal(1, 1, 300)
        got += [(k, i, float(v), None if i % 50 == 7 else int(v > 1)) for i, v in enumerate(x)]
    return got


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame(rows, "stream_id string, seq long, x double, class_idx int")
    return df.withColumn("ts", F.timestamp_seconds(F.lit(START) + F.col("seq") * 10)).cache()


SCORER = {"Ewma": P.RowScorer(lambda key: Ewma(), ("x",))}
CLASSIFIER = {"Last": P.RowClassifier(lambda key: LastClass(), ("x",))}


def values(df, col):
    return {(r["stream_id"], r["seq"]): r[col] for r in df.collect()}


@pytest.mark.parametrize("segment_rows", [1_000_000, 77])
def test_plugins_equal_a_plain_loop(table, rows, segment_rows):
    want = plain(rows)
    got = values(P.run_steps(table.repartition(5), SCORER, "stream_id", reads=["x"], segment_rows=segment_rows), "score")
    assert got == {k: s for k, (s, _) in want.items()}
    got = values(P.run_steps(table, CLASSIFIER, "stream_id", keep=["class_idx"], reads=["x", "class_idx"], label="learner", segment_rows=segment_rows), "pred")
    assert got == {k: p for k, (_, p) in want.items()}


@pytest.mark.parametrize("chunks,files", [(1, 1), (4, 1), (3, 5)])
def test_live_plugins_equal_batch(spark, table, rows, chunks, files):
    want = plain(rows)
    path = V.replay_files(table, "ts", chunks, close_after="1 hour", files_per_chunk=files)
    out = X.steps_stream(V.as_stream(spark, path, max_files=files), SCORER | {"Other": SCORER["Ewma"]}, "stream_id", delay="10 minutes", reads=["x"])
    live = V.run_to_table(out, "live").cache()
    for name in ("Ewma", "Other"):
        assert values(live.filter(F.col("algorithm") == name), "score") == {k: s for k, (s, _) in want.items()}  # null key included
    assert live.count() == 2 * len(rows)


def test_late_rows_are_dropped_and_rows_in_time_are_put_in_order(spark, tmp_path):
    at = lambda s: f"timestamp_seconds({START} + {s})"
    folder = str(tmp_path / "in")
    files = [[(0, 0), (2, 200)], [(1, 100), (3, 1000)], [(4, 1100)], [(9, 150), (5, 1200)], [(None, 9000)]]
    for i, chunk in enumerate(files):
        part = spark.createDataFrame(chunk, "seq long, s long").selectExpr("'a' as stream_id", "seq", f"{at('s')} as ts", "cast(seq as double) as x")
        part.coalesce(1).write.mode("append").parquet(folder)
    out = X.steps_stream(V.as_stream(spark, folder), {"Ewma": SCORER["Ewma"]}, "stream_id", delay="120 seconds", keep=["ts"], reads=["x"])
    got = V.run_to_table(out, "late").orderBy("ts").collect()
    assert [r["seq"] for r in got] == [0, 1, 2, 3, 4, 5]  # 9 came after the rows around it had been handed over
    assert [r["score"] for r in got][:3] == [None, 1.0, pytest.approx(1.9)]


def test_a_run_can_be_stopped_and_resumed(spark, table, rows, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (table.filter("seq < 140"), table.filter("seq >= 140")):
        V.replay_files(part, "ts", 2, path=folder)
        steps = X.steps_stream(V.as_stream(spark, folder), SCORER, "stream_id", delay="5 minutes", reads=["x"])
        V.run_to_table(steps, "resumed", path=out, checkpoint=state)
    V.replay_files(table.limit(1).selectExpr("stream_id", "cast(null as long) as seq", "x", "class_idx", f"timestamp_seconds({START} + 90000) as ts"), "ts", 1, path=folder)
    steps = X.steps_stream(V.as_stream(spark, folder), SCORER, "stream_id", delay="5 minutes", reads=["x"])
    got = V.run_to_table(steps, "resumed", path=out, checkpoint=state)
    assert values(got, "score") == {k: s for k, (s, _) in plain(rows).items()}


def error_rows():
    rng = np.random.default_rng(8)
    got = []
    for k, turn in (("a", 500), ("b", 300), (None, 700)):
        e = (rng.random(1000) < np.where(np.arange(1000) < turn, 0.1, 0.6)).astype(float)
        got += [(k, i, float(x)) for i, x in enumerate(e)]
    return got


@pytest.mark.parametrize("chunks", [1, 6])
def test_live_detectors_equal_batch(spark, chunks):
    df = spark.createDataFrame(error_rows(), "stream_id string, seq long, error double").withColumn("ts", F.timestamp_seconds(F.lit(START) + F.col("seq") * 3))
    path = V.replay_files(df, "ts", chunks, close_after="1 hour")
    for live, batch in ((X.ddm_stream, D.ddm), (X.adwin_stream, D.adwin)):
        got = V.run_to_table(live(V.as_stream(spark, path), delay="5 minutes"), "detector")
        want = values(batch(df), "state")
        assert values(got, "state") == want and "change" in want.values()
    p = df.select("stream_id", "seq", "ts", F.lit(0).alias("truth"), F.col("error").cast("int").alias("pred"))
    path = V.replay_files(p, "ts", chunks, close_after="1 hour")
    got = V.run_to_table(X.drift_monitor_stream(V.as_stream(spark, path), delay="5 minutes"), "monitor")
    rows = lambda d: sorted(map(str, d.select("stream_id", "detector", "seq").collect()))
    assert rows(got) == rows(D.drift_monitor(p))


@pytest.mark.parametrize("plugin", [D.DdmStep(), D.AdwinStep(), DspotStep(warmup=50, depth=10, q=0.02, t_quantile=0.9)])
def test_steps_do_not_depend_on_the_cuts(plugin):
    import pandas as pd

    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"error": (rng.random(700) < 0.2).astype(float), "score": rng.exponential(1, 700)})
    state, whole = plugin.step(plugin.init(("a",)), rows)
    state, parts, at = plugin.init(("a",)), [], 0
    for size in (1, 49, 50, 300, 299, 1):
        state, got = plugin.step(state, rows.iloc[at:at + size])
        parts.append(pd.DataFrame(got))
        at += size
    assert pd.concat(parts, ignore_index=True).equals(pd.DataFrame(whole))


def test_live_dspot_scores_a_null_key(spark, table):
    s = table.filter("stream_id is null").withColumnRenamed("x", "score")
    settings = {"q": 0.02, "depth": 15, "t_quantile": 0.9, "warmup": 60}
    path = V.replay_files(s, "ts", 2, close_after="1 hour")
    live = V.run_to_table(V.dspot_stream(V.as_stream(spark, path), delay="5 minutes", **settings), "t")
    want = dspot(s, **settings)
    assert live.count() == 300 and values(live, "threshold") == values(want, "threshold")


def test_plugins_in_experiments(table):
    rows = table.filter("class_idx is not null and stream_id is not null")
    rows = P.run_steps(rows, SCORER, "stream_id", reads=["x"]).select("stream_id", "seq").join(rows, ["stream_id", "seq"])
    algorithms = SCORER | {"HST": S.HalfSpaceTrees(window=60, trees=5)}
    run = anomaly_experiment(rows, ["x"], algorithms, 100, 20, threshold=0.6, keys="stream_id")
    assert {(r["stream_id"], r["algorithm"]) for r in run.report.collect()} == {(k, a) for k in ("a", "b") for a in ("Ewma", "HST")}
    both = classification_experiment(rows, ["x"], CLASSIFIER | L.learners(["HT"]), 100, 100, 2, keys="stream_id")
    assert {r["learner"] for r in both.report.collect()} == {"Last", "HoeffdingTree"}
    assert both.predictions.count() == 2 * rows.count()
    with pytest.raises(ValueError, match="frozen"):
        anomaly_experiment(rows, ["x"], SCORER, 100, 20, mode="frozen")


def test_plugins_of_one_run_share_their_columns(table):
    with pytest.raises(ValueError, match="same columns"):
        P.run_steps(table, SCORER | CLASSIFIER, "stream_id")
    with pytest.raises(ValueError, match="keys"):
        X.steps_stream(table, SCORER, ())
    one = P.run_steps(table.filter("stream_id = 'a'"), SCORER, reads=["x"])
    assert one.columns == ["seq", "algorithm", "score"] and one.count() == 300


def test_detector_states_stay_small():
    import pickle

    small, large = Adwin(), Adwin()
    small.process(np.tile([0.0, 1.0], 500))
    large.process(np.tile([0.0, 1.0], 50_000))
    assert len(pickle.dumps(large)) < 3 * len(pickle.dumps(small)) and len(pickle.dumps(Ddm())) < 1000


def test_live_summary_fills_gaps_in_any_batches(spark):
    from flowstream.operators.windowing import window_summary

    rng = np.random.default_rng(3)
    at = np.sort(rng.choice(40_000, 150, replace=False))
    big = 2**60 + 1  # whole numbers stay exact
    rows = [(int(t), int(rng.integers(1, 5)), float(rng.random()), big if i == 3 else int(i), "BENIGN" if i % 3 else "Syn") for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "t long, `Source Port` int, Rate double, Bytes long, Label string")
    df = df.select(F.timestamp_seconds(F.col("t") + START).alias("Timestamp"), "`Source Port`", "Rate", "Bytes", "Label")
    want = window_summary(df, freq="1 minute")
    rounded = lambda d: sorted(map(str, d.select("Timestamp", F.round("Source Port_Entropy", 9), F.round("Rate", 9), "Bytes", "Label").collect()))
    for chunks in (1, 5):
        path = V.replay_files(df, "Timestamp", chunks, close_after="2 hours")
        got = V.run_to_table(V.window_summary_stream(V.as_stream(spark, path), freq="1 minute", delay="10 minutes", fill_gaps=True), "filled")
        assert dict(got.dtypes)["Bytes"] == "bigint" and got.columns == want.columns
        assert rounded(got) == rounded(want)


class _State:
    """A state variable in memory that counts the calls to it; on Spark each is a message to the state store."""

    calls = 0

    def __init__(self):
        self.value, self.items = None, []

    def get(self):
        _State.calls += 1
        return self.value

    def exists(self):
        _State.calls += 1
        return self.value is not None

    def update(self, value):
        _State.calls += 1
        self.value = value

    def appendValue(self, value):
        _State.calls += 1
        self.items.append(value)

    def put(self, values):
        _State.calls += 1
        self.items = list(values)

    def clear(self):
        _State.calls += 1
        self.value, self.items = None, []


class _List(_State):
    def get(self):
        _State.calls += 1
        return iter(self.items)


class _Handle:
    def getValueState(self, *_):
        return _State()

    def getListState(self, *_):
        return _List()

    def registerTimer(self, millis):
        pass


class _Watermark:
    def __init__(self, millis):
        self.millis = millis

    def getCurrentWatermarkInMs(self):
        return self.millis


class _Sum:
    def __init__(self):
        self.total = 0.0

    def score_instance(self, x):
        return self.total

    def train(self, x):
        self.total += x[0]


@pytest.mark.parametrize("old_state", [False, True])
def test_live_rows_are_put_in_order_with_few_calls(old_state):
    """Rows that come out of order, over several micro-batches; at most ten messages to the state store for a batch and its timer.
    Waiting rows of a checkpoint that holds whole tables are read as well."""
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"key": 7, "seq": np.arange(60), "x": rng.integers(1, 9, 60), "note": pd.Series(["a", None, "c"] * 20, dtype="string"),
                         "ts": pd.to_datetime(np.arange(60) // 2 * 1000, unit="ms")})
    stepper = X._Stepper({"S": P.RowScorer(lambda key: _Sum(), ("x",))}, list(rows.columns), "ts", "seq", ["key", "seq", "note"], "algorithm", ["score"])
    stepper.init(_Handle())
    got = []
    for b in range(3):
        part = rows.iloc[b * 20:b * 20 + 20].sample(frac=1, random_state=b)
        if old_state and b == 0:
            blob = io.BytesIO()
            part.to_pickle(blob)
            stepper.waiting.appendValue((blob.getvalue(),))
        else:
            part = pd.concat([part, part.iloc[:1].assign(seq=pd.NA)])  # a row without a position tells the time only
            part["seq"] = part["seq"].astype("Int64").astype(float)
            before = _State.calls
            got += list(stepper.handleInputRows((7,), iter([part]), _Watermark(b * 10_000 - 1)))
        if old_state and b == 0:
            before = _State.calls
        got += list(stepper.handleExpiredTimer((7,), _Watermark(b * 10_000 + 9_000 - (500 if b < 2 else 0)), None))
        assert _State.calls - before <= 10
    got += list(stepper.handleExpiredTimer((7,), _Watermark(10**9), None))
    out = pd.concat(got, ignore_index=True)
    assert out.columns.tolist() == ["key", "seq", "note", "algorithm", "score"]
    assert out["seq"].tolist() == rows["seq"].tolist() and out["score"].tolist() == (rows["x"].cumsum() - rows["x"]).tolist()
    assert out["note"].isna().tolist() == rows["note"].isna().tolist()
