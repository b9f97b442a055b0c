"""Queries on roles, work groups, choices, nested validation, rotations, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import seconds_per_tick
from ..operators import contracts, features, histograms, records, selection, similarity
from ..plans.checkpoints import checkpoint
from ..plans.score import TICKS_PER_BEAT as TPB
from ..sources import midi, tables
from .content import STYLE, _style
from .features import LEGACY, PC, _legacy_long
from .files import BACK, _folder
from .melody import SWEEP
from .records import DISTANCE, GRP, MEANS, _compared
from .registry import query
from .tasks import MATRIX

#: An order-free digest of a group's piece_ids: sums of the 64-bit limbs of their sha256.
_LIMBS = ", ".join(f"sum(CAST('0x' || substr(sha256(CAST(piece_id AS VARCHAR)), {16 * k + 1}, 16) AS UBIGINT)::HUGEINT) % 18446744073709551616" for k in range(4))
DIGEST = f"sha256(concat_ws('|', count(*), {_LIMBS}))"

SLUG = "regexp_replace(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT c_custkey, {SLUG.format(x='t')} AS slug FROM (SELECT c_custkey, replace(replace(c_name, 'u', 'ü'), 'm', 'é') || ' Ñ' || c_custkey || '. ' AS t FROM customer) c")
def accent_slug(s):
    text = F.concat(F.replace(F.replace(F.col("c_name"), F.lit("u"), F.lit("ü")), F.lit("m"), F.lit("é")), F.lit(" Ñ"), F.col("c_custkey").cast("string"), F.lit(". "))
    return s.table("customer").select("c_custkey", selection.ascii_slug(text).alias("slug"))


TITLED = """SELECT piece_id, ['Bach', 'Beethoven', 'Chopin', 'Haydn'][1 + piece_id % 4] AS composer, [['fugue_BWV_' || group_id, 'Italian Concerto ' || group_id, 'Prelude_bwv_' || group_id || '_b'][1 + piece_id % 3], ['Piano_Sonatas_' || group_id || '-1', 'Eroica Variations', 'piano_sonatas_' || group_id][1 + piece_id % 3],
    ['Sonata_' || group_id || '_2nd', 'Ballade no. ' || group_id, 'Sonata_' || group_id][1 + piece_id % 3], ['Keyboard_Sonatas_' || group_id || '-3', 'Andante con variazioni', 'Piano_Sonatas_' || group_id][1 + piece_id % 3]][1 + piece_id % 4] AS title FROM piece"""


@query(
    f"""SELECT piece_id, {SLUG.format(x="composer")} || '--' || coalesce(CASE composer WHEN 'Bach' THEN 'bwv-' || nullif(regexp_extract(title, '(?:Prelude|Fugue)_bwv_(\\d+)', 1, 'i'), '') WHEN 'Beethoven' THEN 'piano-sonata-' || nullif(regexp_extract(title, '^Piano_Sonatas_(\\d+)(?:-|$)', 1, 'i'), '')
    WHEN 'Chopin' THEN 'sonata-' || nullif(regexp_extract(title, '^Sonata_(\\d+)(?:_|$)', 1, 'i'), '') ELSE 'keyboard-sonata-' || nullif(regexp_extract(title, '^(?:Piano|Keyboard)_Sonatas_(\\d+)(?:-|$)', 1, 'i'), '') END, {SLUG.format(x="title")}) AS work FROM ({TITLED}) t"""
)
def work_groups(s):
    g, three = F.col("group_id").cast("string"), (1 + F.pmod("piece_id", F.lit(3))).cast("int")
    one = lambda *forms: F.element_at(F.array(*(F.concat(*(g if x is None else F.lit(x) for x in f)) for f in forms)), three)
    titles = F.array(
        one(("fugue_BWV_", None), ("Italian Concerto ", None), ("Prelude_bwv_", None, "_b")), one(("Piano_Sonatas_", None, "-1"), ("Eroica Variations",), ("piano_sonatas_", None)),
        one(("Sonata_", None, "_2nd"), ("Ballade no. ", None), ("Sonata_", None)), one(("Keyboard_Sonatas_", None, "-3"), ("Andante con variazioni",), ("Piano_Sonatas_", None)),
    )
    four = (1 + F.pmod("piece_id", F.lit(4))).cast("int")
    rows = s.piece.select("piece_id", F.element_at(F.array(*map(F.lit, ("Bach", "Beethoven", "Chopin", "Haydn"))), four).alias("composer"), F.element_at(titles, four).alias("title"))
    return rows.select("piece_id", selection.work_group(F.col("composer"), F.col("title")).alias("work"))


@query("SELECT piece_id, composer, CASE WHEN composer IN ('AFRICA', 'AMERICA', 'ASIA') THEN 'known' ELSE 'unknown_calibration' END AS open_role FROM piece WHERE composer NOT IN ('MIDDLE EAST') UNION ALL SELECT piece_id, composer, 'unknown_test' FROM piece WHERE composer = 'MIDDLE EAST'")
def open_roles(s):
    return selection.open_roles(s.piece.select("piece_id", "composer"), "composer", ["AFRICA", "AMERICA", "ASIA"], ["EUROPE"], ["MIDDLE EAST"])


@query(f"SELECT piece_id, CAST(idx AS INTEGER) AS idx, value FROM ({LEGACY}) v WHERE idx NOT IN (0, 38, 39, 40)", rounds="value")
def score_only_variant(s):
    return selection.score_only(_legacy_long(s)).select("piece_id", F.col("idx").cast("int").alias("idx"), "value")


VARIANTS = "(SELECT 'full' AS variant, i AS idx FROM (SELECT unnest(range(12)) AS i) UNION ALL SELECT 'naturals', i FROM (SELECT unnest([0, 2, 4, 5, 7, 9, 11]) AS i))"
NESTED = f"""WITH v AS MATERIALIZED (SELECT p.piece_id, r.repeat, CASE WHEN r.repeat = 0 THEN p.fold ELSE p.group_id % 5 END AS fold, p.composer, x.idx, x.value, w.variant FROM ({PC}) x JOIN piece p USING (piece_id) JOIN {VARIANTS} w ON w.idx = x.idx, (SELECT unnest([0, 1]) AS repeat) r),
    fo AS (SELECT DISTINCT repeat, fold AS f FROM v), m AS (SELECT v.variant, v.repeat, a.f AS o, b.f AS h, v.composer, v.idx, avg(v.value) AS mean FROM v JOIN fo a USING (repeat) JOIN fo b USING (repeat) WHERE v.fold NOT IN (a.f, b.f) GROUP BY ALL),
    d AS (SELECT v.variant, v.repeat, m.o, v.piece_id, v.fold, v.composer AS t, m.composer AS guess, round(sum(abs(v.value - mean)), 6) AS d1, round(sqrt(sum((v.value - mean) ** 2)), 6) AS d2 FROM v JOIN m ON m.variant = v.variant AND m.repeat = v.repeat AND m.h = v.fold AND m.idx = v.idx GROUP BY ALL),
    p AS (SELECT variant, repeat, o, piece_id, fold, t, k AS param, arg_min(guess, (CASE k WHEN 1 THEN d1 ELSE d2 END, guess)) AS g FROM d, (SELECT unnest([1, 2]) AS k) GROUP BY ALL),
    r AS (SELECT variant, repeat, o, fold, param, t, avg(CAST(t = g AS INTEGER)) AS recall FROM p WHERE fold <> o GROUP BY ALL), b AS (SELECT variant, repeat, o, fold, param, avg(recall) AS ba FROM r GROUP BY ALL),
    s AS (SELECT variant, repeat, o, param, round(avg(ba), 9) AS score FROM b GROUP BY ALL), c AS (SELECT variant, repeat, o, arg_max(param, (score, -param)) AS param FROM s GROUP BY ALL)
    SELECT variant, repeat, p.o AS fold, piece_id, t AS true_label, g AS predicted_label, param FROM p JOIN c USING (variant, repeat, o, param) WHERE p.fold = p.o"""


def _pitch_shares(s):
    return histograms.histogram(s.note, F.pmod("pitch", F.lit(12)), 12).select("piece_id", F.posexplode("values").alias("idx", "value"))


def _nested(s):
    repeat = F.explode(F.array(F.struct(F.lit(0).alias("repeat"), F.col("fold").alias("f")), F.struct(F.lit(1).alias("repeat"), F.pmod("group_id", F.lit(5)).alias("f"))))
    samples = s.piece.select("piece_id", "composer", repeat.alias("x")).select("piece_id", "composer", "x.repeat", F.col("x.f").alias("fold"))
    variants = s.spark.createDataFrame([("full", i) for i in range(12)] + [("naturals", i) for i in (0, 2, 4, 5, 7, 9, 11)], "variant string, idx int")
    return selection.nested_centroid(checkpoint(_pitch_shares(s)), samples, variants)


@query(NESTED)
def nested_cv_centroid(s):
    return _nested(s)


SUMMARY = f"SELECT variant, repeat, avg(recall) AS balanced_accuracy FROM (SELECT variant, repeat, true_label, avg(CAST(true_label = predicted_label AS INTEGER)) AS recall FROM ({NESTED}) n GROUP BY ALL) r GROUP BY ALL"


def _summaries(s):
    recall = _nested(s).groupBy("variant", "repeat", "true_label").agg(F.avg((F.col("true_label") == F.col("predicted_label")).cast("double")).alias("recall"))
    return recall.groupBy("variant", "repeat").agg(F.avg("recall").alias("balanced_accuracy"))


@query(SUMMARY, rounds="balanced_accuracy")
def nested_cv_summary(s):
    return _summaries(s)


@query(f"SELECT 'full' AS variant, 'repeat ' || repeat AS model, balanced_accuracy FROM ({SUMMARY}) x WHERE variant = 'full' ORDER BY round(balanced_accuracy, 9) DESC, repeat LIMIT 1", rounds="balanced_accuracy")
def best_summary(s):
    named = _summaries(s).select("variant", F.concat(F.lit("repeat "), "repeat").alias("model"), F.round("balanced_accuracy", 9).alias("balanced_accuracy"))
    return selection.best_summary(named.unionAll(named.withColumns({"model": F.lit("dummy"), "balanced_accuracy": F.lit(1.0)})))


DISTANCES = f"""WITH v AS MATERIALIZED (SELECT p.piece_id, p.fold, p.composer, x.idx, x.value FROM ({PC}) x JOIN piece p USING (piece_id)), m AS (SELECT f.fold, t.composer, t.idx, avg(t.value) AS mean FROM (SELECT DISTINCT fold FROM piece) f JOIN v t ON t.fold <> f.fold GROUP BY ALL)
    SELECT v.piece_id, v.fold, v.composer AS true_label, m.composer AS guess, round(sqrt(sum((v.value - m.mean) ** 2)), 6) + 0.0 AS d FROM v JOIN m ON m.fold = v.fold AND m.idx = v.idx GROUP BY ALL"""


@query(
    f"""WITH d AS MATERIALIZED ({DISTANCES}), x AS (SELECT u.unknown, piece_id, fold, true_label <> u.unknown AS known, round(1 / (1 + min(d)), 4) AS score FROM d, (SELECT DISTINCT guess AS unknown FROM d) u WHERE guess <> u.unknown GROUP BY ALL),
    n AS (SELECT unknown, score, count_if(known) AS pos, count_if(NOT known) AS neg FROM x WHERE fold IN (0, 1, 2) GROUP BY ALL),
    c AS (SELECT unknown, score, coalesce(sum(pos) OVER w / nullif(sum(pos) OVER (PARTITION BY unknown), 0), 0.0) AS tpr, coalesce(sum(neg) OVER w / nullif(sum(neg) OVER (PARTITION BY unknown), 0), 0.0) AS fpr FROM n WINDOW w AS (PARTITION BY unknown ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT unknown, arg_max(score, (round((tpr + 1 - fpr) / 2, 12), round(1 - fpr, 12), score)) AS threshold FROM c WHERE tpr >= 0.8 GROUP BY unknown)
    SELECT unknown, threshold, avg(CASE WHEN known THEN CAST(score >= threshold AS INTEGER) END) AS known_recall, avg(CASE WHEN NOT known THEN CAST(score < threshold AS INTEGER) END) AS unknown_recall, avg(CAST(score >= threshold AS INTEGER)) AS coverage FROM x JOIN t USING (unknown) WHERE fold NOT IN (0, 1, 2) GROUP BY ALL""",
    rounds="threshold known_recall unknown_recall coverage",
)
def open_rotations(s):
    return selection.open_rotations(checkpoint(selection.label_distances(_pitch_shares(s), s.piece)), [0, 1, 2], 0.8)


@query(
    f"""WITH v AS MATERIALIZED (SELECT p.fold, p.composer, p.piece_id, x.idx, x.value FROM ({STYLE}) x JOIN piece p USING (piece_id)), h AS (SELECT DISTINCT fold AS held FROM piece),
    m AS (SELECT held, composer, idx, avg(value) AS mean, sqrt(greatest(avg(value * value) - avg(value) ** 2, 0)) AS sd, count(*) AS n FROM v JOIN h ON fold <> held GROUP BY ALL),
    i AS (SELECT held, composer, sha256(string_agg(CAST(piece_id AS VARCHAR), ',' ORDER BY CAST(piece_id AS VARCHAR))) AS fingerprint FROM piece JOIN h ON fold <> held GROUP BY ALL)
    SELECT held AS fold, composer, CAST(idx AS INTEGER) AS idx, mean, CASE WHEN sd < 1e-6 THEN 1.0 ELSE sd END AS std, n, fingerprint FROM m JOIN i USING (held, composer)""",
    rounds="mean std",
)
def profile_export(s):
    """Written once, one folder per label, and read back."""
    path = _folder(s)
    found = selection.train_profiles(_style(s).select("piece_id", "idx", "value"), s.piece)
    found.repartition("composer").write.mode("errorifexists").partitionBy("composer").json(path)
    return s.spark.read.schema("fold int, idx int, mean double, std double, n long, fingerprint string, composer string").json(path).select("fold", "composer", "idx", "mean", "std", "n", "fingerprint")


@query("SELECT composer, fold, arg_min(path, (a, lower(path), path)) AS path, CAST(count(*) - 1 AS BIGINT) AS n_others FROM (SELECT composer, fold, piece_id % 2 = 0 AS a, 'S' || piece_id || CASE WHEN piece_id % 2 = 0 THEN '_no_repeat' ELSE '' END || '.mid' AS path FROM piece) p GROUP BY ALL")
def canonical_scores(s):
    path = F.concat(F.lit("S"), F.col("piece_id").cast("string"), F.when(F.pmod("piece_id", F.lit(2)) == 0, "_no_repeat").otherwise(""), F.lit(".mid"))
    return contracts.canonical_paths(s.piece.withColumn("path", path), ["composer", "fold"]).select("composer", "fold", "path", F.size("others").cast("long").alias("n_others"))


@query("SELECT p_brand || p_type AS feature, sum(p_retailprice) / count(*) AS mean FROM part GROUP BY 1 ORDER BY round(mean, 6) DESC, feature LIMIT 20", rounds="mean")
def top_importance(s):
    rows = s.table("part").groupBy(F.concat("p_brand", "p_type").alias("feature")).agg(F.round(F.sum("p_retailprice") / F.count("*"), 6).alias("mean"))
    return selection.top_features(rows, 20)


@query("SELECT piece_id, CAST(row_number() OVER (ORDER BY group_id, piece_id) AS INTEGER) AS position FROM piece ORDER BY group_id, piece_id LIMIT 10")
def listening_set(s):
    return selection.listening_set(s.piece, 6, ["group_id", "piece_id"]).select("piece_id", "position")


@query("SELECT composer, avg(CAST(piece_id % 4 <> 0 AS INTEGER)) AS valid, avg(piece_id % 10) AS content, -avg(CAST(piece_id % 3 = 0 AS INTEGER)) AS fallback, count(DISTINCT piece_id % 6) / count(*) AS diversity, avg(group_id) AS style FROM piece GROUP BY composer", rounds="valid content fallback diversity style")
def selection_keys(s):
    of = lambda n: F.pmod("piece_id", F.lit(n))
    rows = s.piece.select("composer", (of(4) != 0).alias("valid"), of(10).cast("double").alias("content"), (of(3) == 0).alias("fallback"), of(6).alias("output"), F.col("group_id").cast("double").alias("style_gain"))
    return selection.selection_key(rows, ["composer"]).select("composer", "key.*")


@query("SELECT 'form' || group_id % 4 AS form, avg(piece_id % 7) AS accuracy, CAST(row_number() OVER (ORDER BY round(avg(piece_id % 7), 9), 'form' || group_id % 4) AS INTEGER) AS position FROM piece GROUP BY 1", rounds="accuracy")
def form_order(s):
    from pyspark.sql import Window

    forms = s.piece.groupBy(F.concat(F.lit("form"), F.pmod("group_id", F.lit(4))).alias("form")).agg(F.avg(F.pmod("piece_id", F.lit(7))).alias("accuracy"))
    return forms.withColumn("position", F.row_number().over(Window.orderBy(F.round("accuracy", 9), "form")))  # one row per form


@query("SELECT piece_id, CASE WHEN piece_id % 2 = 0 THEN 'a/' || piece_id || '.mid' ELSE '/elsewhere/' || piece_id || '.mid' END AS path, CASE WHEN group_id % 3 = 0 THEN 0.0 ELSE 60.0 / ((60 + group_id) * 480) END AS seconds FROM piece", rounds="seconds")
def relative_paths(s):
    path = F.concat(F.when(F.pmod("piece_id", F.lit(2)) == 0, "/data/root/a/").otherwise("/elsewhere/"), F.col("piece_id").cast("string"), F.lit(".mid"))
    bpm = F.when(F.pmod("group_id", F.lit(3)) == 0, 0).otherwise(60 + F.col("group_id")).cast("double")
    return s.piece.select("piece_id", selection.relative_path(path, "/data/root").alias("path"), seconds_per_tick(bpm, F.lit(TPB)).alias("seconds"))


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'empty' WHEN vec_id % 3 = 0 THEN 'length' WHEN vec_id % 7 = 0 THEN 'not finite' END AS problem FROM embeddings")
def distance_inputs(s):
    v = F.transform("embedding", lambda x: x.cast("double"))
    of = lambda n: F.pmod("vec_id", F.lit(n)) == 0
    b = F.when(of(5), F.array().cast("array<double>")).when(of(3), F.slice(v, 1, 5)).when(of(7), F.transform(v, lambda x, i: F.when(i == 3, float("nan")).otherwise(x))).otherwise(v)
    return selection.distance_problems(s.table("embeddings").select("vec_id", v.alias("a"), b.alias("b"))).select("vec_id", "problem")


@query("SELECT label FROM (VALUES ('ATLANTIS'), ('LEMURIA')) v(label)")
def unknown_targets(s):
    asked = s.spark.createDataFrame([("ATLANTIS",), ("ASIA",), ("LEMURIA",)], "label string")
    return selection.unknown_targets(asked, s.table("region").select(F.col("r_name").alias("label")))


@query(f"SELECT fold, composer, count(*) AS n, {DIGEST} AS ids FROM piece GROUP BY ALL")
def split_partitions(s):
    return selection.split_partitions(s.piece, ["fold", "composer"], "piece_id")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day FROM orders")
def timestamps(s):
    """Stamps of records, as text in UTC."""
    return s.table("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("day"))


@query(f"SELECT p.composer || '→' || g.target AS direction, count(*) AS n, avg(style_gain) AS style_gain, CAST(count_if(style_gain > 0) AS BIGINT) AS better FROM (SELECT piece_id, target, round(avg(gain), 9) AS style_gain FROM ({_compared('avg')}) c GROUP BY ALL) g JOIN piece p USING (piece_id) WHERE p.composer <> g.target GROUP BY 1", rounds="style_gain")
def directional_evaluation(s):
    """Every piece with every other label, summed by direction."""
    from .records import _both

    before, after = _both(s, True)
    gains = records.before_after(before, after, ["piece_id", "target"]).groupBy("piece_id", "target").agg(F.round(F.avg("gain"), 9).alias("style_gain"))
    met = gains.join(s.piece.select("piece_id", "composer"), "piece_id").where("composer <> target")
    return met.groupBy(F.concat_ws("→", "composer", "target").alias("direction")).agg(F.count("*").alias("n"), F.avg("style_gain").alias("style_gain"), F.count_if(F.col("style_gain") > 0).alias("better"))


PARSED = BACK.replace("FROM note", "FROM output_note")
PARSED_STYLE = f"SELECT * FROM (WITH note AS ({PARSED}), ends AS (SELECT piece_id, max(tick + duration_ticks) AS end_tick FROM output_note GROUP BY piece_id) SELECT * FROM ({STYLE}) x)"
_side = lambda style: DISTANCE.format(grp=GRP, over="avg", style=style, means=MEANS)


@query(
    f"""SELECT task_id, 'completed' AS status, c.n AS note_count, semantic AS same_events, true AS ticks_per_beat_preserved, true AS smf_format_preserved, true AS meta_preserved, g.style_gain FROM ({MATRIX}) m
    JOIN (SELECT piece_id, target, avg(a.distance - b.distance) AS style_gain FROM ({_side(STYLE)}) a JOIN ({_side(PARSED_STYLE)}) b USING (piece_id, target, grp) GROUP BY ALL) g ON g.piece_id = m.source_id AND g.target = m.target_label
    JOIN (SELECT piece_id, count(*) AS n, true AS semantic FROM output_note GROUP BY piece_id) c ON c.piece_id = m.source_id""",
    rounds="style_gain",
)
def task_execution(s):
    """Each task's output is written as a MIDI file, parsed again, and measured
    as parsed: one plan for all tasks; what does not parse is a failed record."""
    from ..operators import profiles
    from .tasks import _matrix

    files = midi.encoded(s.output, s.meta, TPB).select(F.col("piece_id").cast("string").alias("path"), "content")
    files = checkpoint(files.withColumn("length", F.length("content")).withColumn("sha256", F.sha2("content", 256)))
    checked = midi.checked_files(files).select(F.col("path").cast("long").alias("piece_id"), "ok", "smf_format", "ticks_per_beat")
    raw = checkpoint(midi.raw_events(files).withColumn("piece_id", F.col("path").cast("long")).drop("path"))
    notes, meta = midi.notes_of(raw, "piece_id"), midi.meta_of(raw, "piece_id").select(*s.meta.columns)
    notes = checkpoint(notes)
    torn = s.meta.exceptAll(meta).unionAll(meta.exceptAll(s.meta)).select("piece_id").distinct().withColumn("torn", F.lit(True))

    def style(of):
        own = features.long_vector(features.style_vector(features.structured_notes(of, s.meter, TPB), TPB), features.STYLE_FEATURES)
        return own.withColumn("grp", F.when(F.col("idx") < 22, "rhythm").when(F.col("idx") < 59, "pitch").otherwise("texture"))

    before = checkpoint(style(s.note))
    profile = checkpoint(profiles.target_profile(before.join(s.piece.select("piece_id", "composer"), "piece_id"), ["composer"]).withColumnRenamed("composer", "target"))
    distances = lambda long: profiles.grouped_distance(long, profile, ["idx"], ["piece_id", "target"], True)
    gains = records.before_after(distances(before), distances(style(notes)), ["piece_id", "target"]).groupBy("piece_id", "target").agg(F.avg("gain").alias("style_gain"))
    counts = notes.groupBy("piece_id").agg(F.count("*").alias("note_count")).join(similarity.semantic_equal(s.output, notes).withColumnRenamed("semantic_equal", "same_events"), "piece_id")
    facts = s.piece.select("piece_id", F.col("ticks_per_beat").alias("_t"), F.col("smf_format").alias("_f")).join(checked, "piece_id").join(counts, "piece_id", "left").join(torn, "piece_id", "left")
    facts = facts.select(
        "piece_id", F.when(F.col("ok"), "completed").otherwise("failed").alias("status"), "note_count", "same_events", (F.col("ticks_per_beat") == F.col("_t")).alias("ticks_per_beat_preserved"),
        (F.col("smf_format") == F.col("_f")).alias("smf_format_preserved"), F.col("torn").isNull().alias("meta_preserved"),
    )
    met = _matrix(s).select("task_id", F.col("source_id").alias("piece_id"), F.col("target_label").alias("target"))
    return met.join(facts, "piece_id").join(gains, ["piece_id", "target"], "left").drop("piece_id", "target")


@query(
    """SELECT 'labels' AS section, CAST(1 AS BIGINT) AS line_no, '| composer | n |' AS line UNION ALL SELECT 'labels', 2, '|---|---|' UNION ALL SELECT 'labels', row_number() OVER (ORDER BY composer) + 2, '| ' || composer || ' | ' || n || ' |' FROM (SELECT composer, count(*) AS n FROM piece GROUP BY composer)
    UNION ALL SELECT 'folds', 1, '| fold | groups | first |' UNION ALL SELECT 'folds', 2, '|---|---|---|' UNION ALL SELECT 'folds', row_number() OVER (ORDER BY fold) + 2, '| ' || fold || ' | ' || g || ' | ' || p || ' |' FROM (SELECT fold, count(DISTINCT group_id) AS g, min(piece_id) AS p FROM piece GROUP BY fold)"""
)
def report_lines(s):
    labels = s.piece.groupBy("composer").agg(F.count("*").alias("n"))
    folds = s.piece.groupBy("fold").agg(F.count_distinct("group_id").alias("groups"), F.min("piece_id").alias("first"))
    return tables.report_lines([("labels", labels, ["composer"]), ("folds", folds, ["fold"])])


@query(f"SELECT 'repeat ' || repeat AS model, CAST(0.125 + repeat AS DOUBLE) AS p FROM ({SUMMARY}) x WHERE variant = 'full' ORDER BY round(balanced_accuracy, 9) DESC, repeat LIMIT 1", rounds="p")
def permutation_of_best(s):
    named = _summaries(s).select("variant", F.concat(F.lit("repeat "), "repeat").alias("model"), F.round("balanced_accuracy", 9).alias("balanced_accuracy"))
    tests = s.spark.createDataFrame([("repeat 0", 0.125), ("repeat 1", 1.125), ("dummy", 1.0)], "model string, p double")
    return selection.permutation_of_best(named, tests)


@query(f"SELECT variant, round(avg(balanced_accuracy), 9) AS mean, stddev_pop(balanced_accuracy) AS spread, CAST(row_number() OVER (ORDER BY round(avg(balanced_accuracy), 9) DESC, variant) AS INTEGER) AS position FROM ({SUMMARY}) x GROUP BY variant", rounds="mean spread")
def ablation_order(s):
    return selection.ablation_order(_summaries(s))


@query("SELECT composer AS model, '| ' || composer || ' | ' || CAST(CAST(count(*) AS DECIMAL(9, 3)) AS VARCHAR) || ' | - |' AS line FROM piece WHERE fold % 2 = 0 GROUP BY composer")
def external_report_rows(s):
    rows = s.piece.groupBy(F.col("composer").alias("model"), F.when(F.pmod("fold", F.lit(2)) == 0, "external").otherwise("rotation").alias("scenario")).agg(F.count("*").cast("double").alias("n"))
    return selection.external_rows(rows.withColumn("auroc", F.lit(None).cast("double")), ["n", "auroc"])


def _content_side(table: str, name: str) -> str:
    return f"""(SELECT piece_id, count(*) AS note_count_{name}, count_if(duration_ticks = 0) / count(*) AS zero_duration_ratio_{name}, max(tick + duration_ticks) AS e_{name}, any_value(w.max_polyphony) AS max_polyphony_{name}, any_value(w.mean_polyphony) AS mean_polyphony_{name}
        FROM {table} n JOIN ({SWEEP.format(n=table)}) w USING (piece_id) GROUP BY piece_id)"""


@query(
    f"""SELECT piece_id, note_count_input, zero_duration_ratio_input, max_polyphony_input, mean_polyphony_input, note_count_output, zero_duration_ratio_output, max_polyphony_output, mean_polyphony_output, m.n AS meta_event_count_input, m.n - CAST(piece_id % 5 = 0 AS INTEGER) AS meta_event_count_output,
        e_input / 480 AS length_beats_input, e_output / 480 AS length_beats_output, e_output / e_input AS length_ratio, abs(e_output / e_input - 1) AS length_error, note_count_output / note_count_input AS note_count_ratio, piece_id % 5 <> 0 AS meta_preserved
    FROM {_content_side("note", "input")} a JOIN {_content_side("output_note", "output")} b USING (piece_id) JOIN (SELECT piece_id, count(*) + 1 AS n FROM meter GROUP BY piece_id) m USING (piece_id)""",
    rounds="zero_duration_ratio_input mean_polyphony_input zero_duration_ratio_output mean_polyphony_output length_beats_input length_beats_output length_ratio length_error note_count_ratio",
)
def task_content(s):
    """With the tempo event of every fifth piece lost on the way."""
    return similarity.task_content(s.note, s.output, s.piece, s.meta, s.meta.where("NOT (piece_id % 5 = 0 AND kind = 'tempo')"))
