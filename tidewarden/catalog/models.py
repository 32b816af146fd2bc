"""Training data, splits, evaluation, models and their registry."""

from pyspark.sql import functions as F

from tidewarden.catalog.decisions import window_features
from tidewarden.catalog.flows import features, r6
from tidewarden.catalog.registry import query
from tidewarden.catalog.tables import FLOWS_SQL, STATS_SQL, flows, table, with_sql
from tidewarden.functions.vector import feature_vector
from tidewarden.operators.scoring import score
from tidewarden.operators.serving import chain, classifier_scorer, decision_scorer, sequence_scorer
from tidewarden.session import materialize, run_dir
from tidewarden.sources.labelled import numeric_columns, read_labelled_csv, table_shape, training_table
from tidewarden.training import classifiers as c
from tidewarden.training import evaluate, prepare, registry
from tidewarden.training.isolation_forest import fit_isolation_forest
from tidewarden.training.one_class import fit_one_class
from tidewarden.training.nested_search import nested_search, settings_text
from tidewarden.training.run import train_all
from tidewarden.training.stages import anomaly_pipelines

# Models are fitted at the library's full-size settings. Searches take the full grids on all labelled rows.
# Points that the whole run searches; the full grids have queries of their own.
RUN_GRIDS = {"forest_grid": {"numTrees": [10, 20], "maxDepth": [5, 10]}, "boosting_grid": {"maxIter": [5, 10], "maxDepth": [4]}}


def labelled(spark, sf):
    """Flow records with a label that no single feature gives away: either many packets are sent or many come back, not both.
    Some values are missing."""
    either = (F.col("orig_pkts") >= 4) != (F.col("resp_pkts") >= 3)
    f = flows(spark, sf).withColumn("Label", F.when(either, "attack").otherwise("normal"))
    return f.withColumns({
        "duration": F.when(F.col("record_id") % 17 != 0, F.col("duration")),
        "resp_bytes": F.when(F.col("record_id") % 19 != 0, F.col("resp_bytes")),
    })


def ready(spark, sf):
    t = training_table(labelled(spark, sf), keep=("record_id",))
    return t, [x for x in numeric_columns(t) if x != "record_id"]


LABELLED_SQL = FLOWS_SQL + """,
labelled as materialized (
  select record_id, case when (orig_pkts >= 4) <> (resp_pkts >= 3) then 'attack' else 'normal' end as "Label", src_port, dst_port, case when record_id % 17 <> 0 then duration else 0 end as duration, orig_bytes,
    case when record_id % 19 <> 0 then resp_bytes else 0 end as resp_bytes, missed_bytes, orig_pkts, orig_ip_bytes, resp_pkts, resp_ip_bytes from flows)"""


@query("s7_labelled_csv", with_sql(LABELLED_SQL, """
select record_id, "Label", src_port, dst_port, round(duration, 4) as duration, orig_bytes, resp_bytes, resp_pkts from labelled"""))
def _(spark, sf):
    """The table written as CSV with header and read back with inferred types; empty fields become 0."""
    path = run_dir(spark, "csv")
    labelled(spark, sf).drop("ts").write.option("header", True).csv(path)
    t = read_labelled_csv(spark, path)
    return t.select(F.col("record_id").cast("long").alias("record_id"), "Label", "src_port", "dst_port", F.round("duration", 4).alias("duration"),
                    *[F.col(x).cast("long").alias(x) for x in ("orig_bytes", "resp_bytes", "resp_pkts")])


@query("p17_numeric_only", with_sql(LABELLED_SQL, """
select cast(unnest(range(10)) as integer) as pos, unnest(['src_port', 'dst_port', 'duration', 'orig_bytes', 'resp_bytes', 'missed_bytes', 'orig_pkts',
  'orig_ip_bytes', 'resp_pkts', 'resp_ip_bytes']) as feature, count(*) as num_rows from labelled"""))
def _(spark, sf):
    """The kept columns in order, with the rows they were kept for."""
    t, columns = ready(spark, sf)
    names = F.array(*[F.lit(x) for x in columns])
    return t.agg(F.count(F.lit(1)).alias("num_rows")).select("num_rows", F.posexplode(names).alias("pos", "feature"))


@query("p18_fill_missing", with_sql(LABELLED_SQL, "select record_id, round(duration, 6) as duration, resp_bytes from labelled"))
def _(spark, sf):
    return ready(spark, sf)[0].select("record_id", r6("duration"), "resp_bytes")


@query("a12_table_shape", with_sql(LABELLED_SQL, """select count(*) as num_rows, cast(10 as integer) as num_features, count(distinct "Label") as num_labels from labelled"""))
def _(spark, sf):
    t, _ = ready(spark, sf)
    return table_shape(t.drop("record_id"))


@query("r1_standard_scaling", with_sql(LABELLED_SQL, """
select record_id, round((duration - avg(duration) over ()) / stddev_pop(duration) over (), 5) as duration,
  round((orig_bytes - avg(orig_bytes) over ()) / stddev_pop(orig_bytes) over (), 5) as orig_bytes from labelled"""))
def _(spark, sf):
    t, _ = ready(spark, sf)
    return prepare.standardize(t, ["duration", "orig_bytes"]).select("record_id", F.round("duration", 5).alias("duration"), F.round("orig_bytes", 5).alias("orig_bytes"))


@query("r2_label_codes", with_sql(LABELLED_SQL, """
select "Label", cast(dense_rank() over (order by "Label") - 1 as integer) as code, count(*) as num_rows from labelled group by 1"""))
def _(spark, sf):
    t, _ = ready(spark, sf)
    return t.groupBy("Label").agg(F.count(F.lit(1)).alias("num_rows")).join(prepare.label_codes(t), "Label").select("Label", "code", "num_rows")


@query("r3_stratified_split", with_sql(LABELLED_SQL, """,
ranked as (select record_id, "Label", row_number() over (partition by "Label" order by substr(md5('42:' || record_id), 1, 15), record_id) as pos,
  count(*) over (partition by "Label") as n from labelled)
select record_id, "Label", pos <= floor(n * 0.2) as is_test from ranked"""))
def _(spark, sf):
    t, _ = ready(spark, sf)
    return prepare.stratified_split(t, "record_id").select("record_id", "Label", "is_test")


@query("a20_accuracy", "select round(avg(case when (list_position(embedding, list_max(embedding)) - 1) % 4 = label then 1.0 else 0.0 end), 6) as accuracy from embeddings")
def _(spark, sf):
    from tidewarden.operators.scoring import best_class
    e = table(spark, sf, "embeddings").withColumn("prediction", best_class("embedding") % 4)
    return evaluate.accuracy(e).select(r6("accuracy"))


AUC_SQL = """
with classes as (select unnest(range(4)) as class),
folded as (select label, [list_sum(list_transform(list_filter(embedding, lambda x, i: i % 4 = (c + 1) % 4), lambda x: floor(x::double * 1000)::bigint))::double for c in range(4)] as p
  from embeddings),
scores as (select class, p[class + 1] as score, label = class as positive from folded, classes),
ranked as (select *, rank() over (partition by class order by score) + (count(*) over (partition by class, score) - 1) / 2.0 as r from scores),
auc as (select class, count(case when positive then 1 end) as positives, count(case when not positive then 1 end) as negatives, sum(case when positive then r else 0 end) as rank_sum
  from ranked group by 1)
"""


def embedding_scores(spark, sf):
    """The score of class k: the sum of thousandths, rounded down, of every fourth entry from the k-th on, over whole embeddings."""
    def total(k):
        own = F.filter("embedding", lambda _, i: i % 4 == k)
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc + F.floor(x.cast("double") * 1000)).cast("double")

    return table(spark, sf, "embeddings").select(F.col("label"), F.array(*[total(k) for k in range(4)]).alias("p"))


@query("a21_class_auc", AUC_SQL + """
select cast(class as integer) as class, round((rank_sum - positives * (positives + 1) / 2.0) / (positives * negatives), 6) as auc, positives from auc""")
def _(spark, sf):
    a = evaluate.class_auc(evaluate.class_scores(embedding_scores(spark, sf), "label", "p"))
    return a.select("class", r6("auc"), "positives")


@query("r7_evaluate_scores", AUC_SQL + """
select 'given' as model, 'auc' as metric, round(avg((rank_sum - positives * (positives + 1) / 2.0) / (positives * negatives)), 6) as value from auc where positives > 0
union all select 'given', 'accuracy', round(avg(case when list_position(p, list_max(p)) - 1 = label then 1.0 else 0.0 end), 6) from folded""")
def _(spark, sf):
    """Accuracy and AUC of a fixed score table."""
    from tidewarden.operators.scoring import best_class
    s = embedding_scores(spark, sf).withColumn("prediction", best_class("p"))
    row = lambda df, metric, column: df.select(F.lit("given").alias("model"), F.lit(metric).alias("metric"), r6(column).alias("value"))
    return row(evaluate.mean_auc(s, "label", "p"), "auc", "auc_score").unionByName(row(evaluate.accuracy(s), "accuracy", "accuracy"))


def split(spark, sf):
    t, columns = ready(spark, sf)
    s = materialize(prepare.stratified_split(materialize(t), "record_id"))  # the split reads its table several times
    return s.filter("not is_test"), s.filter("is_test"), columns


# The label follows from two features together, so a sound classifier gives every test row its own label.
PREDICTED_SQL = with_sql(LABELLED_SQL, """,
ranked as (select record_id, "Label", row_number() over (partition by "Label" order by substr(md5('42:' || record_id), 1, 15), record_id) as pos,
  count(*) over (partition by "Label") as n from labelled)
select record_id, "Label", "Label" as predicted from ranked where pos <= floor(n * 0.2)""")


def predicted(spark, sf, estimator):
    train, test, columns = split(spark, sf)
    model = c.fit(train, columns, estimator)
    return c.predict(model, test).select("record_id", "Label", registry.label_of(model).alias("predicted"))


@query("r4_random_forest", PREDICTED_SQL)
def _(spark, sf):
    return predicted(spark, sf, c.random_forest())


@query("r5_gradient_boosting", PREDICTED_SQL)
def _(spark, sf):
    return predicted(spark, sf, c.gradient_boosting(2))


@query("r6_sampled_boosting", PREDICTED_SQL)
def _(spark, sf):
    return predicted(spark, sf, c.sampled_boosting(2))


def vectors(spark, sf):
    return materialize(feature_vector(features(spark, sf)))


@query("r8_isolation_forest")
def _(spark, sf):
    v = vectors(spark, sf)
    model = fit_isolation_forest(v, "window_id")
    return v.select("window_id", model.decision(F.col("vector")).alias("decision"))


@query("r9_one_class")
def _(spark, sf):
    t, columns = ready(spark, sf)
    scaled = materialize(prepare.standardize(t, columns).select("record_id", F.array(*columns).alias("vector")))
    model = fit_one_class(scaled, "vector", len(columns))
    return scaled.select("record_id", (model.decision(F.col("vector")) >= 0).alias("inside"))


@query("r8_outlier_share", with_sql(STATS_SQL, "select count(*) as windows, true as a_tenth_outside, true as scores_in_range from stats"))
def _(spark, sf):
    """Of the windows it was fitted on, the forest leaves out the contamination share."""
    v = vectors(spark, sf)
    model = fit_isolation_forest(v, "window_id")
    scored = v.select((model.decision(F.col("vector")) < 0).cast("double").alias("out"), model.score_samples(F.col("vector")).alias("s"))
    return scored.agg(F.count(F.lit(1)).alias("windows"), F.avg("out").between(0.08, 0.12).alias("a_tenth_outside"),
                      (F.min("s").between(-1, 0) & F.max("s").between(-1, 0)).alias("scores_in_range"))


@query("r9_inside_share", with_sql(LABELLED_SQL, "select count(*) as records, true as nine_tenths_inside from labelled"))
def _(spark, sf):
    """The boundary, saved as a pipeline and loaded by name, holds all but the share it was fitted for."""
    t, _ = ready(spark, sf)
    model = registry.load_model(spark, trained(spark, sf), "one_class")
    return model.transform(t).agg(F.count(F.lit(1)).alias("records"), F.avg((F.col("decision") >= 0).cast("double")).between(0.87, 0.93).alias("nine_tenths_inside"))


def search(spark, sf, estimator, grid):
    t, columns = ready(spark, sf)
    found, _ = nested_search(materialize(t), columns, estimator, grid, "record_id", parallelism=8)
    rows = [(settings_text(s), a) for s, a in found]
    return spark.createDataFrame(rows, "settings string, accuracy double").select("settings", (F.col("accuracy") > 0.95).alias("sound"))


@query("r10_forest_search", """
select 'maxDepth=' || d || ',minInstancesPerNode=' || l || ',numTrees=' || n as settings, true as sound
from (select unnest([10, 20, 30]) as d), (select unnest([1, 2, 5]) as l), (select unnest([100, 200, 300]) as n)""")
def _(spark, sf):
    """All 27 points, each with an accuracy over 0.95."""
    return search(spark, sf, c.random_forest(), c.FOREST_GRID)


@query("r11_boosting_search", """
select 'maxDepth=' || d || ',maxIter=' || n || ',stepSize=' || s as settings, true as sound
from (select unnest([4, 6, 8]) as d), (select unnest([100, 200]) as n), (select unnest(['0.05', '0.1', '0.2']) as s)""")
def _(spark, sf):
    """All 18 points, each with an accuracy over 0.95."""
    return search(spark, sf, c.gradient_boosting(2), c.BOOSTING_GRID)


@query("r12_training_run", """
select unnest(['random_forest', 'random_forest', 'gradient_boosting', 'gradient_boosting', 'sampled_boosting', 'sampled_boosting', 'isolation_forest', 'one_class',
    'random_forest_tuned', 'gradient_boosting_tuned']) as model,
  unnest(['accuracy', 'auc', 'accuracy', 'auc', 'accuracy', 'auc', 'inside_share', 'inside_share', 'cv_accuracy', 'cv_accuracy']) as metric, true as in_range""")
def _(spark, sf):
    """The whole run with full-size models and a small search: classifiers over 0.95, anomaly models at nine tenths inside."""
    found = train_all(labelled(spark, sf).drop("ts"), "record_id", run_dir(spark, "training"), **RUN_GRIDS)
    share = F.when(F.col("metric") == "inside_share", F.col("value").between(0.87, 0.93)).otherwise(F.col("value") > 0.95)
    return found.select("model", "metric", share.alias("in_range"))


def trained(spark, sf):
    """A folder with a saved classifier, the two anomaly models, and run metrics."""
    folder = run_dir(spark, "models")
    train, test, columns = split(spark, sf)
    forest = c.fit(train, columns, c.random_forest())
    registry.save_models(spark, folder, {"random_forest": forest, **anomaly_pipelines(train, columns, "record_id")}, columns)
    registry.append_run(c.evaluate("random_forest", forest, test), folder, "run-1", "flows")
    return folder


MODELS_SQL = """
select unnest(['random_forest', 'isolation_forest', 'one_class']) as name, unnest(['prediction', 'decision', 'decision']) as kind, '1' as version"""


@query("k7_saved_models", MODELS_SQL)
def _(spark, sf):
    return registry.model_table(spark, trained(spark, sf)).select("name", "kind", "version")


@query("k8_feature_manifest", with_sql(LABELLED_SQL, """
select 'src_port,dst_port,duration,orig_bytes,resp_bytes,missed_bytes,orig_pkts,orig_ip_bytes,resp_pkts,resp_ip_bytes' as feature_columns,
  cast(10 as bigint) as num_features, 'random_forest' as model_names, count(*) as num_rows from labelled"""))
def _(spark, sf):
    """The manifest as written to JSON and read back, with the rows of the table it describes."""
    t, columns = ready(spark, sf)
    path = run_dir(spark, "manifest")
    registry.manifest(spark, columns, ["random_forest"]).write.json(path)
    rows = t.select(F.lit(len(columns)).cast("long").alias("num_features")).groupBy("num_features").agg(F.count(F.lit(1)).alias("num_rows"))
    return spark.read.json(path).join(rows, "num_features").select(
        F.array_join("feature_columns", ",").alias("feature_columns"), "num_features", F.array_join("model_names", ",").alias("model_names"), "num_rows")


@query("k9_run_metrics", """
select 'run-1' as run_id, 'flows' as experiment, 'random_forest' as model, unnest(['accuracy', 'auc']) as metric, 1.0::double as value""")
def _(spark, sf):
    return registry.runs(spark, trained(spark, sf)).withColumn("value", F.round("value", 6))


@query("s10_load_scorer", with_sql(LABELLED_SQL, 'select record_id, "Label" as predicted from labelled'))
def _(spark, sf):
    """Score the whole table with a model loaded by name."""
    model = registry.load_model(spark, trained(spark, sf), "random_forest")
    t, _ = ready(spark, sf)
    return model.transform(t).select("record_id", registry.label_of(model).alias("predicted"))


@query("m7_model_list", f"select *, name = 'one_class' as loaded from ({MODELS_SQL})")
def _(spark, sf):
    """Models with the time of their last load, of which only one was loaded."""
    folder = trained(spark, sf)
    registry.load_model(spark, folder, "one_class")
    listed = registry.list_models(spark, folder)
    return listed.select("name", "kind", "version", F.coalesce(F.col("load_seconds") > 0, F.lit(False)).alias("loaded"))


E5_COLUMNS = ["byte_count", "packet_count", "entropy", "SYN", "FIN"]


def window_vectors(spark, sf):
    """Window vectors with two flags as columns, and a label that needs both."""
    v = vectors(spark, sf)
    flags = {n: F.coalesce(F.try_element_at("tcp_flags", F.lit(n)), F.lit(0)) for n in ("SYN", "FIN")}
    flagged = v.withColumns(flags)
    return flagged.withColumn("Label", F.when((F.col("SYN") > 0) & (F.col("FIN") == 0), "attack").otherwise("normal"))


@query("e5_model_scoring")
def _(spark, sf):
    """Anomaly pipeline, classifier and sequence scorer, chained and fused over every flow window."""
    v = window_vectors(spark, sf)
    scorers = chain(
        decision_scorer(anomaly_pipelines(v, E5_COLUMNS, "window_id")["isolation_forest"]),
        classifier_scorer(c.fit(v, E5_COLUMNS, c.random_forest())),
        sequence_scorer(lambda block: block[:, -1, 2] / (block[:, :, 2].sum(axis=1) + 1.0), 5),
    )
    return score(v, scorers).select("window_id", "prediction", "severity", "risk_score", "anomaly_score", "sequence_anomaly_score")


@query("e5_classifier_scoring", with_sql(STATS_SQL, """
select window_id, case when syn > 0 and coalesce(fin, 0) = 0 then 'attack' else 'normal' end as prediction,
  case when syn > 0 and coalesce(fin, 0) = 0 then 'high' else 'low' end as severity from stats"""))
def _(spark, sf):
    """Verdicts by a classifier that was saved and loaded by name."""
    v = window_vectors(spark, sf)
    folder = run_dir(spark, "models")
    registry.save_models(spark, folder, {"verdicts": c.fit(v, E5_COLUMNS, c.random_forest())}, E5_COLUMNS)
    return score(v, classifier_scorer(registry.load_model(spark, folder, "verdicts"))).select("window_id", "prediction", "severity")
