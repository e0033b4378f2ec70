"""Note features, MIDI files, sequences and file sources."""

import gzip
import io
import json
import math
import tarfile

import numpy as np
import pytest
from kinfold.functions import music
from kinfold.operators import features, sequences
from kinfold.sources import files, midi
from pyspark.sql import functions as F


def song(notes, ppq=480, extra=(), order=None, channel=0):
    marks = sorted([(t * ppq // 480, 1, bytes([0x90 | channel, p, v])) for t, d, p, v in notes] + [((t + d) * ppq // 480, 0, bytes([0x80 | channel, p, 0])) for t, d, p, v in notes])
    at, track = 0, [(0, e) for e in extra]
    for t, _, e in marks:
        track.append((t - at, e))
        at = t
    return track


TUNE = [(0, 240, 60, 90), (240, 240, 64, 90), (480, 160, 67, 80), (640, 480, 72, 100)]


def test_reader_and_note_rules():
    raw = midi.write([song(TUNE)])
    assert [(n["onset"], n["duration"], n["pitch"]) for n in midi.melodic_notes(raw)] == [(0.0, 0.5, 60), (0.5, 0.5, 64), (1.0, 1 / 3, 67), (640 / 480, 1.0, 72)]
    running = midi.write([[(0, bytes([0x90, 60, 90])), (240, bytes([60, 0]))]])
    assert midi.melodic_notes(running)[0]["duration"] == 0.5
    open_ = midi.write([[(0, bytes([0x80, 60, 0])), (0, bytes([0x90, 60, 90]))]])
    assert midi.melodic_notes(open_)[0]["duration"] == 0.25
    with pytest.raises(ValueError, match="unclosed active MIDI note: channel=0 pitch=60 count=1"):
        midi.normalised_notes(open_)
    with pytest.raises(ValueError, match="NO_NOTES"):
        midi.quantised_notes(open_)
    drums = midi.write([song(TUNE, channel=9)])
    with pytest.raises(ValueError, match="no non-drum notes"):
        midi.melodic_notes(drums)
    assert {r[2] for r in midi.quantised_notes(drums)} == {8} and all(n["is_drum"] for n in midi.normalised_notes(drums))
    two = midi.write([[(0, bytes([0x90, 60, 1])), (10, bytes([0x90, 60, 2])), (10, bytes([0x80, 60, 0])), (10, bytes([0x80, 60, 0]))]])
    assert [(n["velocity"], n["duration"] * 480) for n in midi.melodic_notes(two)] == [(1, 20.0), (2, 20.0)]
    with pytest.raises(ValueError):
        midi.read(b"RIFF....")
    meter = midi.write([[(0, b"\xff\x58\x04\x03\x02\x18\x08"), *song(TUNE)]])
    with pytest.raises(ValueError, match="NON_4_4_METER"):
        midi.quantised_notes(meter)


def test_structural_relations():
    base = midi.write([song(TUNE), song([(0, 960, 36, 50)])])
    swapped = midi.write([song([(0, 960, 36, 50)]), song(TUNE)])
    named = midi.write([song(TUNE, extra=[b"\xff\x03\x03abc"]), song([(0, 960, 36, 50)])])
    other = midi.write([song([(0, 240, 61, 90), *TUNE[1:]]), song([(0, 960, 36, 50)])])
    h = midi.event_hashes
    assert midi.relation(h(base), h(base)) == "BYTE_EXACT" and midi.relation(h(base), h(named)) == "CANONICAL_EQUIVALENT"
    assert midi.relation(h(base), h(swapped)) == "TRACK_ORDER_EQUIVALENT" and midi.relation(h(base), h(other)) == "STRUCTURALLY_NONEXACT"
    n = midi.normalised_hash
    fine = midi.write([song(TUNE, 960), song([(0, 960, 36, 50)], 960)], 960)
    assert n(base) == n(swapped) == n(named) == n(fine) != n(other)
    for change in ((1, 240, 60, 90), (0, 241, 60, 90), (0, 240, 60, 91)):
        assert n(midi.write([song([change, *TUNE[1:]])])) != n(midi.write([song(TUNE)]))


def test_spark_sides_of_midi(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.mid").write_bytes(midi.write([song(TUNE)]))
    (tmp_path / "y.MIDI").write_bytes(b"broken")
    (tmp_path / "z.txt").write_text("no")
    found = midi.files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in midi.parse(found).collect()}
    assert set(got) == {"x.mid", "y.MIDI"} and len(got["x.mid"].notes) == 4 and got["y.MIDI"].notes is None and got["y.MIDI"].error.startswith("ValueError")
    assert midi.note_table(midi.parse(found)).count() == 4
    h = {r.path.rsplit("/", 1)[1]: r for r in midi.hashes(found).collect()}
    assert h["x.mid"].normalised_sha256 == midi.normalised_hash(midi.write([song(TUNE)])) and h["y.MIDI"].error
    rows = midi.quantised(found).where("error is null").select(F.col("path").alias("piece"), F.explode("rows").alias("r")).select("piece", "r.*")
    tokens = sequences.encode(rows).orderBy("bar").collect()
    assert [t.tokens[0] for t in tokens] == [midi.BAR] * len(tokens) and sum(len(t.tokens) for t in tokens) == 4 * 5 + len(tokens)
    assert len(midi.vocabulary()) == midi.VOCABULARY == 237


def windows_of(bars, max_bars, prompt, context):
    offsets, flat = {}, []
    for b in sorted(bars):
        offsets[b] = len(flat)
        flat += bars[b]
    total, out = max(bars) + 1, []
    for start in range(0, total - prompt, prompt):
        if start in offsets and start + prompt in offsets:
            for end in range(min(total, start + max_bars), start + prompt, -1):
                stop = next((offsets[b] for b in sorted(bars) if b >= end), len(flat))
                ids = [1, *flat[offsets[start] : stop], 2]
                n = 1 + offsets[start + prompt] - offsets[start]
                if len(ids) <= context and n < len(ids) - 1:
                    out.append((start, end, len(ids), n, ids))
                    break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_windows_match_a_plain_search(spark, seed):
    rng = np.random.default_rng(seed)
    bars = {int(b): [3] + [int(x) for x in rng.integers(4, 237, 5 * rng.integers(1, 6))] for b in rng.choice(40, 25, replace=False)} | {0: [3, 9], 4: [3, 8]}
    df = spark.createDataFrame([("p", b, t) for b, t in bars.items()], "piece string, bar int, tokens array<int>")
    got = sorted((r.start_bar, r.end_bar, r.token_count, r.prompt_token_count, r.token_ids) for r in sequences.windows(df, 16, 4, 120).collect())
    assert got == windows_of(bars, 16, 4, 120)


def test_scalar_functions(spark):
    r = spark.range(1).select(
        music.quantise(F.lit(0.125)).alias("q"), music.quantise(F.lit(99.0)).alias("top"), music.log_bucket(F.lit(1.0)).alias("b"), music.log_bucket(F.lit(0.0)).alias("lo"),
        music.rotate_mask(F.lit(0x801), F.lit(1)).alias("m"), music.canonical_chroma(F.array(F.lit(0b100), F.lit(0b1000))).alias("c"),
        music.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), music.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("zero"), music.peak_first(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("p"),
        music.ratio(F.lit(2.0), F.lit(4.0)).alias("r"), music.masked_mean(F.array(F.lit(1.0), F.lit(5.0)), F.array(F.lit(1), F.lit(0))).alias("mm"),
        music.prompt_mask(F.array(F.lit(1), F.lit(1), F.lit(1), F.lit(0)), F.array(F.lit(0), F.lit(0), F.lit(1), F.lit(0))).alias("pm"),
    ).first()
    assert (r.q, r.top, r.b, r.lo, r.m, r.c, r.u, r.zero, r.p, r.r, r.mm, r.pm) == (2, 192, 8, 0, 0x003, [1, 2], [0.6, 0.8], [0.0, 0.0], [3.0, 3.0, 1.0], 0.5, 1.0, [1, 1, 0, 0])


def test_ngrams_are_sampled(spark):
    df = spark.createDataFrame([(list(range(10)),), ([1],), ([],)], "v array<int>")
    got = [r.g for r in df.select(features.grams(F.col("v"), 3, 4).alias("g")).collect()]
    assert got == [[[0, 1, 2], [2, 3, 4], [4, 5, 6], [6, 7, 8]], [], []]


def test_detector_joins_copies(spark):
    rng = np.random.default_rng(3)
    rows = []
    for piece in range(12):
        if piece % 3 != 2:
            tune = rng.integers(40, 90, 60).tolist() if piece % 3 == 0 else rows_of
            rows_of = tune
        else:
            tune = rng.integers(40, 90, 60).tolist()
        rows += [(piece, i / 2, 0.5, int(p), 80, 0, 0) for i, p in enumerate(tune)]
    notes = spark.createDataFrame(rows, "piece int, onset double, duration double, pitch int, velocity int, program int, track int")
    trees = {"baseline": -3.0, "offsets": [0, 3], "leaf": [0, 1, 1], "feature": [0, 0, 0], "threshold": [0.9, 0, 0], "left": [1, 0, 0], "right": [2, 0, 0], "missing_left": [1, 0, 0], "value": [0, 0.0, 6.0]}
    out = features.detect(notes, trees, k=3, threshold=0.9, mutual=3)
    assert len(out["pairs"].columns) == 2 + 47 + 1 + 1
    assert {(r.a, r.b) for r in out["decisions"].collect()} == {(i, i + 1) for i in range(0, 12, 3)}
    parsed = spark.createDataFrame([(str(i), "bad" if i == 12 else None) for i in range(13)], "path string, error string")
    total = features.run_summary(notes.select("piece").distinct(), parsed, out["decisions"]).first()
    assert tuple(total) == (13, 12, 8, 4, 4, 0)


def test_tree_scores_route_missing_values(spark):
    trees = {"baseline": 0.5, "offsets": [0, 3], "leaf": [0, 1, 1], "feature": [0, 0, 0], "threshold": [1.0, 0, 0], "left": [1, 0, 0], "right": [2, 0, 0], "missing_left": [0, 0, 0], "value": [0, -1.0, 2.0]}
    df = spark.createDataFrame([(1, 1.0), (2, 1.5), (3, None), (4, float("nan"))], "i int, x double")
    got = {r.i: r.score for r in features.score_trees(df, ["x"], trees).collect()}
    s = lambda v: 1 / (1 + math.exp(-v))
    assert [round(got[i], 12) for i in (1, 2, 3, 4)] == [round(s(v), 12) for v in (-0.5, 2.5, 2.5, 2.5)] and df.columns == ["i", "x"]


def test_neighbours_exact_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    v[7] = v[8] = v[9]
    monkeypatch.setattr(features, "BLOCK", 25)
    got = features.knn_cosine(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "piece int, vector array<double>"), 4).collect()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    d = np.round(1 - u @ u.T, 12)
    for i in range(60):
        want = sorted((j for j in range(60) if j != i), key=lambda j: (d[i, j], j))[:4]
        assert [r.b for r in sorted((r for r in got if r.a == i), key=lambda r: r.rank)] == want


def test_manifest_paths_stay_inside():
    assert files.inside("/r", "a/./b") == "/r/a/b"
    for bad in ("/etc/x", "../x", "a/../../x"):
        with pytest.raises(ValueError):
            files.inside("/r", bad)


def test_file_sources(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "rows.jsonl").write_text('{"id":"a","tokens":1}\n\n{"id":"b","tokens":2}\n')
    rows = files.read_jsonl(spark, f"{p}/rows.jsonl", "id string, tokens long")
    assert rows.count() == 2
    files.write_jsonl(rows, f"{p}/out")
    line = next(x for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines())
    assert list(json.loads(line)) == ["id", "tokens"]
    with gzip.open(tmp_path / "map.json.gz", "wt") as f:
        json.dump({"x": "f1", "y": "f2"}, f)
    assert {tuple(r) for r in files.read_json_map(spark, f"{p}/map.json.gz").collect()} == {("x", "f1"), ("y", "f2")}
    with gzip.open(tmp_path / "slots.csv.gz", "wt") as f:
        f.write("condition,slot_index,donor_id\nclean,1,a\nclean,1,\nleak,1,b\n")
    slots = {(r.condition, r.slot_index): r.donor_id for r in files.read_slots(spark, f"{p}/slots.csv.gz").collect()}
    assert slots == {("clean", "1"): None, ("leak", "1"): "b"}
    (tmp_path / "rel.json").write_text(json.dumps({"q__A": ["r__B", "s__a"], "r__B": ["q__A"]}))
    assert {(r.a, r.b) for r in files.relation_edges(files.read_relations(spark, f"{p}/rel.json")).collect()} == {("a", "b"), ("a", "a")}
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        for name in ("d/One.mid", "d/two.mid"):
            info = tarfile.TarInfo(name)
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
    members = files.archive_members(spark, f"{p}/t.tar.gz", {"one", "none"})
    assert [(r.id, bytes(r.content)) for r in members.collect()] == [("one", b"abc")]
    import hashlib

    need = spark.createDataFrame([("one", hashlib.sha256(b"abc").hexdigest()), ("none", "x")], "id string, sha256 string")
    assert {r.id: r.problem for r in files.verified_members(members, need).collect()} == {"one": None, "none": "missing"}
    sums = files.checksums(spark, f"{p}/rel.json").collect()[0]
    assert sums.sha256 == hashlib.sha256((tmp_path / "rel.json").read_bytes()).hexdigest()
    packed = spark.createDataFrame([(0, 1, [1, 2, 3]), (1, 1, [4, 5])], "slot int, prompt int, token_ids array<int>")
    files.write_packed(packed, f"{p}/packed")
    assert [r.token_ids for r in files.read_packed(spark, f"{p}/packed").orderBy("slot").collect()] == [[1, 2, 3], [4, 5]]
    flat = spark.createDataFrame([([1, 2, 3, 4, 5],)], "token_ids array<int>")
    spans = sequences.packed_offsets(packed.select("slot", F.lit("s").alias("s"), F.size("token_ids").alias("n")), "s", "slot")
    assert [r.token_ids for r in sequences.unpack(flat, spans).orderBy("slot").collect()] == [[1, 2, 3], [4, 5]]
    files.write_table(packed.select("slot", "prompt"), f"{p}/csv")
    assert files.numbers(files.read_table(spark, f"{p}/csv"), ["slot"]).agg(F.sum("slot")).first()[0] == 1.0


def plain_harmony(slots, sizes, limit=None, most=None):
    """(token, tf) of one piece by listing all of its half beats."""
    first = min(slots)
    line = [slots.get(s, 0) for s in range(first, max(slots) + 1)][:most]
    out: dict = {}
    for n in sizes:
        runs = len(line) - n + 1
        for k in range(0, max(runs, 0), 1 if limit is None else max(1, math.ceil(runs / limit))):
            least = min([((m << s) | (m >> (12 - s))) & 4095 for m in line[k : k + n]] for s in range(12))
            token = f"h{n}:" + ",".join(map(str, least))
            out[token] = out.get(token, 0) + 1
    return out


@pytest.mark.parametrize("limit, most", [(None, None), (7, 90), (512, 2048)])
def test_harmony_takes_whole_pieces(spark, limit, most):
    """Pieces of up to 5,000 half beats, of which a cut at 2,048 would lose most; also a piece of one note and a dense one."""
    rng = np.random.default_rng(4)
    rows = [(p, float(rng.integers(0, 2500)), int(rng.integers(0, 128))) for p in range(6) for _ in range(80)] + [(6, 3.0, 61)] + [(7, i / 2, 60 + i % 9) for i in range(40)]
    got: dict = {}
    for r in features.harmony_bags(spark.createDataFrame(rows, "piece int, onset double, pitch int"), limit=limit, most=most).collect():
        assert r.grp == "harmony" and r.token not in got.setdefault(r.piece, {})
        got[r.piece][r.token] = r.tf
    for p in range(8):
        slots: dict = {}
        for q, onset, pitch in rows:
            if q == p:
                slots[round(onset * 2)] = slots.get(round(onset * 2), 0) | 1 << pitch % 12
        assert got.get(p, {}) == plain_harmony(slots, (2, 4, 8), limit, most)


def test_half_beats_and_steps_are_whole(spark):
    far = spark.createDataFrame([(1, 0.0, 60), (1, 2000.0, 61)], "piece int, onset double, pitch int")
    assert features.half_beats(far).count() == 4001 and features.half_beats(far, most=2048).count() == 2048
    steps = spark.createDataFrame([(1, k, k % 5, 0, k % 7) for k in range(5000)], "piece int, seq int, melody int, bass int, rhythm int")
    total = {r.grp: r.n for r in features.step_bags(steps).groupBy("grp").agg(F.sum("tf").alias("n")).collect()}
    assert total == {"melody": 4 * 5000 - 10, "bass": 4 * 5000 - 10, "rhythm": 3 * 5000 - 6, "motif": 4998}


def test_json_map_in_parts(spark, tmp_path):
    """Many parts, one object: keys sorted, no part holds all; odd texts come back; other layouts of the same object are read too."""
    rows = [(f"k{i:04d}", f"v{i}") for i in range(2000)] + [('"q", {x}\\', "a},{b\n"), ("", "empty"), (",", "{"), ("none", None)]
    df = spark.createDataFrame(rows, "id string, family_id string").repartition(3)
    path = str(tmp_path / "map")
    files.write_json_map(df, path, compression="gzip")
    found = sorted((tmp_path / "map").glob("part-*"))
    texts = [gzip.open(p, "rt", newline="").read() for p in found]
    whole = json.loads("".join(texts))
    assert whole == dict(rows) and list(whole) == sorted(whole) and max(map(len, texts)) < 0.6 * sum(map(len, texts))
    assert sorted(map(repr, map(tuple, files.read_json_map(spark, path).collect()))) == sorted(map(repr, rows))
    for k, text in enumerate((json.dumps(dict(rows)), json.dumps(dict(rows), indent=2), json.dumps(dict(rows)).replace(": ", ":\n"))):
        (tmp_path / f"{k}.json").write_text(text)
        assert sorted(map(repr, map(tuple, files.read_json_map(spark, str(tmp_path / f"{k}.json")).collect()))) == sorted(map(repr, rows))
    with pytest.raises(Exception, match="repeated key"):
        files.write_json_map(df.unionByName(df.where("id = 'k0001'")), str(tmp_path / "twice"))


def test_neighbour_rows_are_not_sorted_whole(spark, monkeypatch):
    """Many equal distances, text ids, several chunks: the same neighbours as a full sort."""
    rng = np.random.default_rng(2)
    v = rng.integers(-1, 2, size=(150, 3)).astype(float) + 1e-9
    ids = [f"n{i}" for i in range(150)]
    monkeypatch.setattr(features, "BLOCK", 40)
    got: dict = {}
    for r in features.knn_cosine(spark.createDataFrame(list(zip(ids, v.tolist())), "piece string, vector array<double>"), 6).collect():
        got.setdefault(r.a, {})[r.rank] = r.b
    u = v / np.linalg.norm(v, axis=1)[:, None]
    d = np.round(1 - u @ u.T, 12)
    for i, a in enumerate(ids):
        want = sorted((j for j in range(150) if j != i), key=lambda j: (d[i, j], ids[j]))[:6]
        assert sorted(got[a]) == [1, 2, 3, 4, 5, 6] and all(np.isclose(d[i, ids.index(got[a][k + 1])], d[i, j], atol=3e-12) for k, j in enumerate(want))
