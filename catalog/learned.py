"""Queries on classifiers and feature importance (lineitem, embeddings, events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import stream, table
from flowstream.functions.columns import collapse_prediction, encode_index
from flowstream.operators import evaluation as E
from flowstream.operators import learners as L
from flowstream.operators import ranking as R
from flowstream.operators.ordering import with_seq
from flowstream.plans.experiments import class_profile, classification_experiment, drift_study, feature_consensus
from flowstream.session import written

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WIDE_ROWS = 400  # rows of a training window of the query over one long stream
WINDOW_ROWS = 100  # rows of a training window of the queries with one stream per supplier


def _supplier_lines(spark, d):
    """Line items by ship date, one stream per supplier, with a planted target: large quantity at a high discount."""
    li = table(spark, d, "lineitem")
    y = (F.col("l_quantity") > 25) & (F.col("l_discount") > 0.05)
    li = li.select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", *FEATURES, y.cast("int").alias("class_idx"))
    return with_seq(li, ["l_shipdate", "l_orderkey", "l_linenumber", *FEATURES], by="l_suppkey")


def _run(short, params):
    def query(spark, d):
        preds = L.prequential_classify(_supplier_lines(spark, d), FEATURES, L.learners([short], {short: params}), WINDOW_ROWS, 2, keys="l_suppkey")
        return preds.select("l_suppkey", "learner", "seq", "truth", "pred")
    return query


def learner_accuracy(spark, d):
    """Four learners over each supplier's stream in the same job."""
    configured = L.learners(overrides={"LB": {"members": 8}, "ARF": {"members": 8, "max_features": 0.8}})
    return E.cumulative_accuracy(L.prequential_classify(_supplier_lines(spark, d), FEATURES, configured, WINDOW_ROWS, 2, keys="l_suppkey"))


def classification_report(spark, d):
    """Per supplier and learner, the first window left out."""
    run = classification_experiment(_supplier_lines(spark, d), FEATURES, L.learners(["HT", "HAT"]), 250, WINDOW_ROWS, 2, warmup=WINDOW_ROWS, keys="l_suppkey")
    return run.report


def classifier_grid(spark, d):
    """Four trials on each supplier's stream in the same job."""
    grid = [{"grace": 100, "criterion": "gini"}, {"grace": 200, "leaf": "majority"}, {"criterion": "hellinger", "tie": 0.1}, {"leaf": "nb", "confidence": 1e-4}]
    return L.classifier_sweep(_supplier_lines(spark, d), FEATURES, "HT", grid, WINDOW_ROWS, 2, keys="l_suppkey")


def drift_report(spark, d):
    """An adaptive tree on each supplier's stream, whose target turns round half way: metrics per window (kind
    'window') and the detections of both detectors (kind 'detection')."""
    s = _supplier_lines(spark, d)
    halves = s.groupBy("l_suppkey").agg(F.expr("count(*) div 2").alias("half"))
    turned = s.join(halves, "l_suppkey").withColumn("class_idx", F.when(F.col("seq") < F.col("half"), F.col("class_idx")).otherwise(1 - F.col("class_idx")))
    study = drift_study(turned.drop("half"), FEATURES, L.hoeffding_adaptive_tree(), WINDOW_ROWS, WINDOW_ROWS, 2, keys="l_suppkey")
    found = [t.withColumn("kind", F.lit(kind)) for kind, t in (("window", study.windows), ("detection", study.detections))]
    return found[0].unionByName(found[1], allowMissingColumns=True)


def embedding_classes(spark, d):
    """Ten classes, 64 features, one long stream: each window is a job, so jobs grow with the rows."""
    cols = [f"f{i}" for i in range(64)]
    e = table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    s = written(with_seq(e, ["vec_id"]), "wide")
    classes = s.agg(F.max("label") + 1).first()[0]
    preds = L.prequential_classify(s, cols, L.learners(["HT"], {"HT": {"grace": 50, "leaf": "nb"}}), WIDE_ROWS, classes, target="label")
    return preds.select("seq", "truth", "pred")


def _typed(spark, d):
    li = table(spark, d, "lineitem")
    y = F.when(F.col("l_quantity") > 40, 1).when(F.col("l_discount") > 0.07, 2).otherwise(0)
    return li.select(*FEATURES, y.alias("y"))


def rf_top_features(spark, d):
    got = R.rf_importances(_typed(spark, d), FEATURES, "y", depth=5)
    return spark.createDataFrame([(i, f) for i, (f, _) in enumerate(got[:2])], "rank int, feature string")


def ovr_importance(spark, d):
    ranked = R.ovr_feature_importance(_typed(spark, d), FEATURES, "y", ["BENIGN", "big", "cheap"], 1, trees=20, depth=5)
    return ranked.filter("class <> 'BENIGN'").select("class", "feature")


def consensus(spark, d):
    """Best two features per return flag's line items, votes over the three sets."""
    li = table(spark, d, "lineitem")
    y = F.when((F.col("l_quantity") > 25) & (F.col("l_discount") > 0.05), "attack").otherwise("BENIGN")
    li = li.select("l_orderkey", "l_linenumber", "l_returnflag", *FEATURES, y.alias("Label"))
    sets = [li.filter(F.col("l_returnflag") == f).drop("l_returnflag") for f in ("A", "N", "R")]
    return feature_consensus(sets, 2, order_by=["l_orderkey", "l_linenumber", *FEATURES], extra_ignore=["l_orderkey", "l_linenumber"],
                             normalize="MinMaxScaler", imputation="mediana").select("feature", "votes")


def profile(spark, d):
    got = class_profile(_typed(spark, d), FEATURES, "y", ["BENIGN", "big", "cheap"], 4, trees=10, depth=5)
    return got.class_distances.select("a", "b", F.round("distance", 6).alias("distance"))


QUERIES = {f.__name__: f for f in [learner_accuracy, classification_report, classifier_grid, drift_report, embedding_classes, rf_top_features,
                                   ovr_importance]}
QUERIES |= {"hoeffding_tree": _run("HT", {}), "hat": _run("HAT", {}), "leveraging_bagging": _run("LB", {"members": 10}),
            "arf": _run("ARF", {"members": 10}), "feature_consensus": consensus, "class_profile": profile}

# The planted classes depend on these two features alone.
ORACLE = {
    "rf_top_features": "select * from (values (0, 'l_quantity'), (1, 'l_discount')) t(rank, feature)",
    "ovr_importance": "select * from (values ('big', 'l_quantity'), ('cheap', 'l_discount')) t(class, feature)",
    "feature_consensus": """select feature, count(distinct l_returnflag) as votes from lineitem, (values ('l_quantity'), ('l_discount')) t(feature)
      where l_returnflag in ('A', 'N', 'R') group by feature""",
    "class_profile": f"""with t as (select *, case when l_quantity > 40 then 1 when l_discount > 0.07 then 2 else 0 end as y from lineitem),
      s as (select y as class, {", ".join(f"avg({c}) as {c}" for c in FEATURES)} from t group by 1),
      u as (unpivot s on {", ".join(FEATURES)} into name feature value m),
      z as (select class, feature, (m - min(m) over w) / (max(m) over w - min(m) over w) as v from u window w as (partition by feature))
      select x.class as a, y.class as b, round(sqrt(sum((x.v - y.v) ** 2)), 6) as distance
      from z x join z y on x.feature = y.feature and x.class < y.class group by 1, 2""",
}
