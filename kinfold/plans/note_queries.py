"""Note, feature, neighbour and sequence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import music
from kinfold.operators import features, sequences
from kinfold.plans import views
from kinfold.plans.catalogue import query
from kinfold.plans.family_queries import R, rounded
from kinfold.runtime import materialise
from kinfold.sources import midi


def _flat(df: DataFrame, c: str, digits: int = 6) -> DataFrame:
    """A vector as text, so that engines compare it the same way."""
    return df.withColumn(c, F.array_join(F.transform(c, lambda x: F.format_number(F.round(x, digits) + F.lit(0.0), digits)), ","))


@query(f"WITH {views.NOTES} SELECT piece, slot, melody, bass FROM slots")
def melody_bass_slots(spark: SparkSession, sf: str) -> DataFrame:
    return features.slots(views.notes(spark, sf))


@query(f"WITH {views.NOTES} SELECT piece, seq::INT AS seq, melody, bass, rhythm, gap FROM steps")
def melody_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return features.intervals(features.slots(views.notes(spark, sf)))


#: Text of an n-gram over a column of steps.
def _gram(c: str, n: int, prefix: str) -> str:
    lead = ", ".join(f"lead({c}, {k}) OVER w" for k in range(n))
    return f"SELECT piece, '{prefix}' || concat_ws(',', {lead}) AS token, row_number() OVER w AS k, count(*) OVER (PARTITION BY piece) - {n - 1} AS runs FROM steps WINDOW w AS (PARTITION BY piece ORDER BY seq)"


_MELODY = "bags AS (SELECT piece, 'melody' AS grp, token, count(*) AS tf FROM (" + " UNION ALL ".join(_gram("melody", n, f"mi{n}:") for n in (2, 3, 4, 5)) + ") WHERE k <= runs GROUP BY ALL UNION ALL SELECT piece, 'bass', token, count(*) FROM (" + " UNION ALL ".join(_gram("bass", n, f"bi{n}:") for n in (2, 3, 4, 5)) + ") WHERE k <= runs GROUP BY ALL UNION ALL SELECT piece, 'rhythm', token, count(*) FROM (" + " UNION ALL ".join(_gram("rhythm", n, f"r{n}:") for n in (2, 3, 4)) + ") WHERE k <= runs GROUP BY ALL)"


@query(f"WITH {views.NOTES}, {_MELODY} SELECT * FROM bags")
def interval_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return features.step_bags(features.intervals(features.slots(views.notes(spark, sf)))).where("grp <> 'motif'")


@query(f"""WITH {views.NOTES}, p AS (SELECT piece, seq, '(' || melody || ', ' || rhythm || ')' AS pair FROM steps), g AS (SELECT piece, 'mr3:(' || concat_ws(', ', pair, lead(pair) OVER w, lead(pair, 2) OVER w) || ')' AS token, row_number() OVER w AS k, count(*) OVER (PARTITION BY piece) - 2 AS runs FROM p WINDOW w AS (PARTITION BY piece ORDER BY seq)) SELECT piece, 'motif' AS grp, token, count(*) AS tf FROM g WHERE k <= runs GROUP BY ALL""")
def motif_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return features.motif_tokens(features.intervals(features.slots(views.notes(spark, sf))))


_MASKS = "hb AS (SELECT piece, round_even(onset * 2, 0)::INT AS slot, bit_or((1 << (pitch % 12))::INT) AS mask FROM notes GROUP BY ALL), ends AS (SELECT piece, min(slot) AS a, max(slot) AS b FROM hb GROUP BY piece), masks AS (SELECT e.piece, (s - a)::INT AS seq, coalesce(mask, 0) AS mask FROM (SELECT piece, a, unnest(range(a, least(b, a + 2047) + 1)) AS s FROM ends) e LEFT JOIN hb ON hb.piece = e.piece AND hb.slot = e.s)"


@query(f"WITH {views.NOTES}, {_MASKS} SELECT piece, seq, mask FROM masks")
def half_beat_masks(spark: SparkSession, sf: str) -> DataFrame:
    return features.half_beats(views.notes(spark, sf), most=2048)


@query(f"""WITH {views.NOTES}, {_MASKS}, g AS (SELECT piece, [mask, lead(mask) OVER w, lead(mask, 2) OVER w, lead(mask, 3) OVER w] AS m, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY piece) - 3 AS runs FROM masks WINDOW w AS (PARTITION BY piece ORDER BY seq)),
t AS (SELECT piece, list_min(list_transform(range(12), lambda s: list_transform(m, lambda v: ((v << s::INT) | (v >> (12 - s)::INT)) & 4095))) AS c FROM g WHERE k < runs AND k % greatest(1, ceil(runs / 512)::BIGINT) = 0) SELECT piece, 'h4:' || array_to_string(c, ',') AS token, count(*) AS tf FROM t GROUP BY ALL""")
def harmony_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return features.harmony_bags(views.notes(spark, sf), (4,), limit=512, most=2048).select("piece", "token", "tf")


def _unit_sql(rows: str, bucket: str, weight: str, width: int) -> str:
    return f"v AS (SELECT p.piece, k, coalesce(w, 0) AS w FROM (SELECT DISTINCT piece FROM {rows}) p CROSS JOIN range({width}) r(k) LEFT JOIN (SELECT piece, {bucket} AS k, sum({weight}) AS w FROM {rows} GROUP BY ALL) x USING (piece, k))"


def _vector_sql(name: str) -> str:
    return f"SELECT piece, string_agg(format('{{:.6f}}', round(w / n, 6) + 0.0), ',' ORDER BY k) AS {name} FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY piece)) AS n FROM v) GROUP BY piece"


_BUCKET = "least(greatest(round_even(2 * log2(greatest({0}, 0.03125)), 0)::INT + 8, 0), 15)"


@query(f"WITH {views.NOTES}, {_unit_sql('notes', 'pitch % 12', 'greatest(duration, 0.125) * greatest(velocity, 1)', 12)} {_vector_sql('chroma')}")
def chroma_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(features.chroma(views.notes(spark, sf)), "chroma")


@query(f"WITH {views.NOTES}, {_unit_sql('notes', _BUCKET.format('duration'), '1.0', 16)} {_vector_sql('duration_hist')}")
def duration_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(features.duration_histogram(views.notes(spark, sf)), "duration_hist")


@query(f"WITH {views.NOTES}, {_unit_sql('steps', _BUCKET.format('gap'), '1.0', 16)} {_vector_sql('ioi_hist')}")
def ioi_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(features.ioi_histogram(features.intervals(features.slots(views.notes(spark, sf)))), "ioi_hist")


@query(f"WITH {views.NOTES}, {_unit_sql('steps', 'melody + 37', '1.0', 75)} {_vector_sql('interval_hist')}")
def interval_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(features.interval_histogram(features.intervals(features.slots(views.notes(spark, sf)))), "interval_hist")


@query(f"""WITH {views.NOTES} SELECT piece, count(*)::DOUBLE AS notes, count(DISTINCT round_even(onset * 4, 0))::DOUBLE AS onsets, max(onset + duration) AS beats, count(DISTINCT track)::DOUBLE AS tracks, min(pitch)::DOUBLE AS pitch_min, max(pitch)::DOUBLE AS pitch_max, round(avg(pitch), 9) AS pitch_mean, round(stddev_pop(pitch), 9) AS pitch_sd, count(DISTINCT program)::DOUBLE AS programs, count(DISTINCT round_even(onset * 2, 0))::DOUBLE AS half_beats FROM notes GROUP BY piece""")
def scalar_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.scalars(views.notes(spark, sf)), "pitch_mean", "pitch_sd")


_TFIDF = """n AS (SELECT count(DISTINCT piece) AS n FROM notes), df AS (SELECT grp, token, count(*) AS df FROM bags GROUP BY ALL), raw AS (SELECT piece, grp, token, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS raw FROM bags JOIN df USING (grp, token), n), wt AS (SELECT piece, grp, token, raw / sqrt(sum(raw * raw) OVER (PARTITION BY piece, grp)) AS weight FROM raw)"""


def _weights(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n = views.notes(spark, sf)
    bags = materialise(features.step_bags(features.intervals(features.slots(n))).where("grp <> 'motif'"))
    return bags, materialise(features.tfidf(bags, n.select("piece").distinct().count()))


@query(f"WITH {views.NOTES}, {_MELODY}, {_TFIDF} SELECT piece, grp, token, round(weight, 9) AS weight FROM wt")
def tfidf_terms(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_weights(spark, sf)[1], "weight")


def _neighbour_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces with the three that follow them by number."""
    p = views.table(spark, sf, "events").select(F.col("user_id").alias("a")).distinct()
    return p.select("a", F.explode(F.array(*(F.col("a") + k for k in (1, 2, 3)))).alias("b"))


_NEXT = "pairs AS (SELECT a, a + k AS b FROM (SELECT DISTINCT user_id AS a FROM events), (VALUES (1), (2), (3)) t(k))"


@query(f"WITH {views.NOTES}, {_MELODY}, {_TFIDF}, {_NEXT} SELECT a, b, x.grp, round(sum(x.weight * y.weight), 9) AS cosine FROM pairs JOIN wt x ON x.piece = a JOIN wt y ON y.piece = b AND y.grp = x.grp AND y.token = x.token GROUP BY ALL")
def tfidf_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.sparse_cosine(_weights(spark, sf)[1], _neighbour_pairs(spark, sf)), "cosine")


@query(f"""WITH {views.NOTES}, {_MELODY}, {_NEXT}, c AS (SELECT piece, grp, count(*) AS n FROM bags GROUP BY ALL), s AS (SELECT a, b, x.grp, count(*) AS shared FROM pairs JOIN bags x ON x.piece = a JOIN bags y ON y.piece = b AND y.grp = x.grp AND y.token = x.token GROUP BY ALL)
SELECT p.a, p.b, x.grp, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / greatest(x.n + coalesce(y.n, 0) - coalesce(shared, 0), 1), 9) AS jaccard, round(coalesce(shared, 0) / greatest(least(x.n, coalesce(y.n, 0)), 1), 9) AS containment FROM pairs p JOIN c x ON x.piece = p.a LEFT JOIN c y ON y.piece = p.b AND y.grp = x.grp LEFT JOIN s ON s.a = p.a AND s.b = p.b AND s.grp = x.grp""")
def set_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.set_overlap(_weights(spark, sf)[0], _neighbour_pairs(spark, sf)), "jaccard", "containment")


_KNN = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e), d AS (SELECT a.id AS a, b.id AS b, round(1 - list_dot_product(a.v, b.v), 12) AS distance FROM u a JOIN u b ON a.id <> b.id), nn AS (SELECT a, b, distance, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank FROM d QUALIFY rank <= 5)"


def _neighbours(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    return features.knn_cosine(views.table(spark, sf, "embeddings"), k, "vec_id", "embedding")


@query(f"WITH {_KNN} SELECT a, b, round(distance, 9) AS distance, rank::INT AS rank FROM nn")
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_neighbours(spark, sf), "distance")


@query(f"""WITH {_KNN}, p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(rank) FILTER (a < b) AS ra, min(rank) FILTER (a > b) AS rb FROM nn GROUP BY ALL) SELECT a, b, round(1 / least(coalesce(ra, 6), coalesce(rb, 6)), 9) AS dense_reciprocal_best_rank, (greatest(coalesce(ra, 6), coalesce(rb, 6)) <= 5)::INT AS dense_mutual, (greatest(coalesce(ra, 6), coalesce(rb, 6)) <= 5)::INT AS mutual_support FROM p""")
def mutual_rank_features(spark: SparkSession, sf: str) -> DataFrame:
    pairs = features.rank_pairs(_neighbours(spark, sf).withColumn("signal", F.lit("dense")), 5, ["dense"])
    return rounded(features.rank_features(pairs, 5, ["dense"]), "dense_reciprocal_best_rank")


@query(f"""WITH {views.NOTES}, {_NEXT}, {_unit_sql('notes', 'pitch % 12', 'greatest(duration, 0.125) * greatest(velocity, 1)', 12)}, q AS (SELECT piece, list(w / n ORDER BY k) AS v FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY piece)) AS n FROM v) GROUP BY piece)
SELECT a, b, round(list_max(list_transform(range(12), lambda s: list_dot_product(x.v, y.v[s + 1:] || y.v[1:s]))), 9) AS chroma_transposition_cosine FROM pairs JOIN q x ON x.piece = a JOIN q y ON y.piece = b""")
def rotation_max_cosine(spark: SparkSession, sf: str) -> DataFrame:
    v = features.chroma(views.notes(spark, sf))
    return rounded(features.vector_cosines(_neighbour_pairs(spark, sf), v, ["chroma"]), "chroma_transposition_cosine")


@query(f"""WITH {views.NOTES}, {_NEXT}, s AS (SELECT piece, count(*)::DOUBLE AS notes, max(onset + duration) AS beats, min(pitch)::DOUBLE AS pitch_min, count(DISTINCT program)::DOUBLE AS programs FROM notes GROUP BY piece) SELECT a, b, round(least(x.notes, y.notes) / greatest(greatest(x.notes, y.notes), 1e-6), 9) AS notes_ratio, round(least(x.beats, y.beats) / greatest(greatest(x.beats, y.beats), 1e-6), 9) AS beats_ratio, abs(x.pitch_min - y.pitch_min) AS pitch_min_absolute_difference, round(least(x.programs, y.programs) / greatest(greatest(x.programs, y.programs), 1e-6), 9) AS programs_ratio FROM pairs JOIN s x ON x.piece = a JOIN s y ON y.piece = b""")
def scalar_pair_features(spark: SparkSession, sf: str) -> DataFrame:
    out = features.scalar_features(_neighbour_pairs(spark, sf), features.scalars(views.notes(spark, sf)))
    return rounded(out.select("a", "b", "notes_ratio", "beats_ratio", "pitch_min_absolute_difference", "programs_ratio"), "notes_ratio", "beats_ratio", "programs_ratio")


def _bar_notes(spark: SparkSession, sf: str) -> DataFrame:
    n = views.notes(spark, sf)
    at = F.rint(F.col("onset") * 4).cast("int")
    return n.select("piece", F.floor(at / 16).cast("int").alias("bar"), F.pmod(at, F.lit(16)).alias("position"), music.program_family(F.col("program") * 16, F.col("track") == 1).alias("family"), "pitch", F.least(F.greatest(F.rint(F.col("duration") * 4).cast("int"), F.lit(1)), F.lit(64)).alias("duration"), music.velocity_step(F.col("velocity")).alias("velocity"))


_BARS = """bn AS (SELECT piece, round_even(onset * 4, 0)::INT // 16 AS bar, round_even(onset * 4, 0)::INT % 16 AS position, CASE WHEN track = 1 THEN 8 ELSE least(7, program) END AS family, pitch, least(greatest(round_even(duration * 4, 0)::INT, 1), 64) AS duration, least(15, velocity * 16 // 128) AS velocity FROM notes),
bars AS (SELECT piece, bar, [3] || flatten(list([4 + position, 20 + family, 29 + pitch, 156 + duration, 221 + velocity] ORDER BY position, family, pitch, duration, velocity)) AS tokens FROM bn GROUP BY ALL)"""


@query(f"WITH {views.NOTES}, {_BARS} SELECT piece, bar, array_to_string(tokens, ',') AS tokens FROM bars")
def bar_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.encode(_bar_notes(spark, sf)).withColumn("tokens", F.array_join(F.transform("tokens", lambda x: x.cast("string")), ","))


@query(f"""WITH {views.NOTES}, {_BARS}, o AS (SELECT piece, bar, len(tokens) AS n, coalesce(sum(len(tokens)) OVER (PARTITION BY piece ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM bars), w AS (SELECT piece, max(bar) + 1 AS bars, sum(n)::BIGINT AS total FROM o GROUP BY piece),
s AS (SELECT a.piece, a.bar AS start_bar, a.o AS b0, c.o AS pe, bars, total FROM o a JOIN o c ON c.piece = a.piece AND c.bar = a.bar + 4 JOIN w ON w.piece = a.piece WHERE a.bar % 4 = 0 AND a.bar < bars - 4), x AS (SELECT *, unnest(range(start_bar + 5, least(bars, start_bar + 16) + 1)) AS end_bar FROM s),
y AS (SELECT x.*, coalesce((SELECT min(o.o) FROM o WHERE o.piece = x.piece AND o.bar >= x.end_bar), total) AS stop FROM x) SELECT piece, start_bar, max(end_bar)::INT AS end_bar, max(stop - b0 + 2) AS token_count, max(pe - b0 + 1) AS prompt_token_count FROM y WHERE stop - b0 + 2 <= 256 AND pe - b0 + 1 < stop - b0 + 1 GROUP BY piece, start_bar""")
def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = sequences.windows(sequences.encode(_bar_notes(spark, sf)), context=256)
    return w.select("piece", "start_bar", "end_bar", "token_count", "prompt_token_count")


@query("SELECT conv_id AS stream, turn AS slot, length(text) AS n, sum(length(text)) OVER w::BIGINT AS stop, (sum(length(text)) OVER w - length(text))::BIGINT AS start FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def packed_offsets(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("slot"), F.char_length("text").cast("bigint").alias("n"))
    return sequences.packed_offsets(c, "stream", "slot")


@query("""WITH t AS (SELECT conv_id AS stream, turn, [length(text)::BIGINT, turn, conv_id] AS ids FROM conversations), h AS (SELECT stream, turn, len(ids) AS n, sha256('[' || array_to_string(ids, ',') || ']') AS h FROM t) SELECT stream, count(*) AS windows, sum(n)::BIGINT AS tokens, sha256(string_agg(h, chr(0) ORDER BY turn)) AS identity FROM h GROUP BY stream""")
def stream_identity(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "conversations").select(F.col("conv_id").alias("stream"), "turn", F.array(F.char_length("text").cast("bigint"), F.col("turn"), F.col("conv_id")).alias("token_ids"))
    return sequences.stream_identity(c, "stream", "turn")


@query("SELECT s AS step, round(CASE WHEN s <= 100 THEN 3e-4 * s / 100 ELSE 3e-4 * 0.5 * (1 + cos(pi() * (s - 100) / 1900.0)) END, 12)::DOUBLE AS rate FROM range(1, 2001) t(s)")
def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1, 2001).select(F.col("id").alias("step"), F.round(music.learning_rate(F.col("id"), 2000, 3e-4, 100), 12).alias("rate"))


@query("SELECT t AS step, i::INT AS place, round(CASE WHEN i < 8 THEN sin(t * exp(-ln(10000.0) * i / 7)) ELSE cos(t * exp(-ln(10000.0) * (i - 8) / 7)) END, 9) AS value FROM range(50) a(t), range(16) b(i)")
def timestep_embedding(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.range(50).select(F.col("id").alias("step"), F.posexplode(music.sinusoid(F.col("id"), 16)).alias("place", "value"))
    return rounded(e, "value")


@query("""WITH c AS (SELECT conv_id, list(length(text)::INT ORDER BY turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(list_transform(range(8), lambda i: CASE WHEN i < len(t) THEN t[i + 1] ELSE 0 END), ',') AS ids, array_to_string(list_transform(range(8), lambda i: (i < len(t))::INT), ',') AS attention, array_to_string(list_transform(range(8), lambda i: (i >= 1 AND i < least(len(t), 8) - 1)::INT), ',') AS loss FROM c""")
def collate_masks(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.char_length("text").cast("int").alias("n")))).alias("x"))
    ids, attention, loss = music.collate(F.transform("x", lambda r: r["n"]), F.lit(1), 8)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return c.select("conv_id", text(ids).alias("ids"), text(attention).alias("attention"), text(loss).alias("loss"))


#: A small hand-made ensemble over four inputs: two trees of three and five nodes.
TREES = {"baseline": -0.2, "offsets": [0, 3, 8], "leaf": [0, 1, 1, 0, 1, 0, 1, 1], "feature": [0, 0, 0, 1, 0, 2, 0, 0], "threshold": [0.1, 0, 0, -0.05, 0, 0.0, 0, 0], "left": [1, 0, 0, 1, 0, 3, 0, 0], "right": [2, 0, 0, 2, 0, 4, 0, 0], "missing_left": [1, 0, 0, 0, 0, 1, 0, 0], "value": [0, -0.7, 0.9, 0, 0.4, 0, -0.3, 1.1]}


@query("""WITH x AS (SELECT vec_id, CASE WHEN vec_id % 17 = 0 THEN NULL ELSE embedding[1] END AS f0, CASE WHEN vec_id % 19 = 0 THEN NULL ELSE embedding[2] END AS f1, embedding[3] AS f2 FROM embeddings)
SELECT vec_id, round(1 / (1 + exp(-(-0.2 + CASE WHEN f0 IS NULL OR f0 <= 0.1::FLOAT THEN -0.7 ELSE 0.9 END + CASE WHEN f1 IS NOT NULL AND f1 <= -0.05 THEN 0.4 WHEN f2 IS NULL OR f2 <= 0 THEN -0.3 ELSE 1.1 END))), 9) AS score FROM x""")
def tree_score(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "embeddings")
    x = e.select("vec_id", F.when(F.col("vec_id") % 17 != 0, F.col("embedding")[0].cast("double")).alias("f0"), F.when(F.col("vec_id") % 19 != 0, F.col("embedding")[1].cast("double")).alias("f1"), F.col("embedding")[2].cast("double").alias("f2"))
    return features.score_trees(x, ["f0", "f1", "f2"], TREES).select("vec_id", F.round("score", R).alias("score"))


@query()
def same_work_detector(spark: SparkSession, sf: str) -> DataFrame:
    """The whole detector over event notes, with a hand-made ensemble on melody cosine, melody overlap and chroma."""
    trees = TREES | {"feature": [0, 0, 0, 1, 0, 18, 0, 0], "threshold": [0.05, 0, 0, 0.02, 0, 0.9, 0, 0]}
    return features.detect(views.notes(spark, sf), trees, k=10, threshold=0.4, mutual=1)["decisions"]


@query()
def smf_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Event notes written as Standard MIDI Files and read back: notes and hashes of each piece."""
    n = views.notes(spark, sf).select("piece", (F.col("onset") * 480).cast("int").alias("t"), (F.col("duration") * 480).cast("int").alias("d"), "pitch", "velocity")
    songs = features.by_piece(n).groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("t", "d", "pitch", "velocity"))).alias("notes"))

    def build(batches):
        import pyarrow as pa

        for b in batches:
            raw = []
            for notes in b.column(1).to_pylist():
                marks = sorted([(x["t"], 1, bytes([0x90, x["pitch"], x["velocity"]])) for x in notes] + [(x["t"] + x["d"], 0, bytes([0x80, x["pitch"], 0])) for x in notes])
                at, track = 0, []
                for t, _, e in marks:
                    track.append((t - at, e))
                    at = t
                raw.append(midi.write([track]))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(raw, pa.binary())], ["path", "content"])

    binary = materialise(songs.mapInArrow(build, "path string, content binary"))  # written once, read by both sides
    parsed = midi.parse(binary).select("path", F.size("notes").alias("notes"), "error")
    return parsed.join(midi.hashes(binary).select("path", "byte_sha256", "normalised_sha256"), "path")
