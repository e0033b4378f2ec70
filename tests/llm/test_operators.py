"""The dealt operators against brute force, and their cases of nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("kinfold.llm")

from kinfold.llm import decontam, imatch, labelled, licences, packing, pii, quality, secrets, simhash, toxicity, urls  # noqa: E402
from kinfold.llm.queries import op2_simhash_near_dedup, op9_licence_scan, word_bpe  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

DOCS = "doc_id long, text string, source string, id string, key string, fp string, words string, score string, n string"
EXTRA = ("x", "y", "z", "w", "s", "n")
LONG = " ".join(f"word{i % 977} lorem" for i in range(30_000))


def docs(spark, rows):
    """Rows of (doc_id, text[, source]) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r[:2], r[2] if len(r) > 2 else "s", *EXTRA) for r in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (4, "two"), (None, "one"), (None, None), (5, LONG), (6, "é ñ 漢字 😀 ok")]


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in linked(i):
            root[find(j)] = find(i)
    return [find(i) for i in range(n)]


# 1


def test_url_rules_match_brute_force(spark):
    rules = {"org/": ("org", "/", "allow"), "example.org/es/": ("example.org", "/es/", "block"), "example.org/en/1": ("example.org", "/en/1", "block"), "com/fr/": ("com", "/fr/", "allow"), "com/de/": ("com", "/de/", "block")}
    rng = random.Random(3)
    seen = [None, "", "nothing", "http://", "HTTP://A.ORG", "x://y://z.com/fr/1", "http://example.org?/es/", "http://ORG/a", "http://torg/", "http://a.com#/fr/"]
    seen += [f"http{rng.choice(['', 's'])}://{rng.choice(['a.example.org', 'example.org', 'b.com', 'com', 'c.net', 'Xexample.org'])}{rng.choice(['/es/', '/en/1', '/en/12?x=/y', '/fr/', '/de/#a', '', '/fr', '?q'])}{rng.randint(0, 9)}" for _ in range(200)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame([(i, u, None, "x", "y") for i, u in enumerate(seen)], "page_id long, url string, html string, host string, verdict string")).collect()}
    for i, u in enumerate(seen):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), m[2]) if m else ("", "")
        fit = [k for k, (h, p, _) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=len) if fit else None
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best), u
        if best:
            assert got[i].verdict == rules[best][2]
        assert got[i].verdict in ("allow", "block")


def test_url_trust_and_distrust_travel_over_links(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [(1, "http://good.org/a", link("near.net")), (2, "http://near.net/", link("far.net")), (3, "http://far.net/", None), (4, "http://bad.com/de/1", ""), (5, "http://pal.net/", link("bad.com")), (6, "http://lone.net/", "<a href='/here'>")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2].trust > got[3].trust > 0 and got[2].verdict == got[3].verdict == "allow"
    assert got[5].distrust > 0 and got[5].verdict == "block"
    assert got[6].trust == got[6].distrust == 0 and got[6].verdict == "allow"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 2


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_brute_force():
    for text in [t for _, t in ODD if t is None or len(t) < 1000] + ["A b\x0bC d e", "a b c d", "Ä ä\x85x\xa0y z", "x " * 50]:
        assert simhash.fingerprint(text) == brute_fingerprint(text), text


@pytest.mark.parametrize("count", [2, 3])
def test_links_have_the_components_of_all_pairs(spark, count):
    rng = random.Random(count)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = {0}
    for s in seeds:
        for _ in range(rng.choice([1, 3, 60])):
            x = s
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    a = np.array(sorted(fps), np.uint64)
    roots = components(len(a), lambda i: np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4).tolist())
    got = simhash.links(spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long"), 4, count).toPandas()
    place = {int(x): i for i, x in enumerate(a.view(np.int64))}
    pairs = defaultdict(list)
    for x, y in zip(got["a"], got["b"]):
        pairs[place[x]].append(place[y])
    assert len(set(zip(roots, components(len(a), lambda i: pairs[i])))) == len(set(roots)) == len(set(components(len(a), lambda i: pairs[i])))


def test_near_duplicates_on_odd_rows(spark):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, ODD)).collect()), key=str)
    assert len(got) == len(ODD)
    zero = [g for g in got if g[1] == "0" * 16]
    assert len(zero) == 4 and {g[2] for g in zero} == {1}
    ones = [g for g in got if g[1] == f"{brute_fingerprint('one'):016x}"]
    assert len(ones) == 3 and {g[2] for g in ones} == {4}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    kept = simhash.keep_one(docs(spark, ODD))
    assert kept.columns == docs(spark, []).columns
    assert Counter(brute_fingerprint(r.text) for r in kept.collect()) == Counter({brute_fingerprint(t): 1 for _, t in ODD})


def test_a_group_of_many_near_copies_has_a_spanning_forest():
    rng = np.random.default_rng(4)
    fp = np.unique(np.uint64(0x123456789ABCDEF0) ^ (np.uint64(1) << rng.integers(0, 64, (4000, 2), dtype=np.uint64)).sum(axis=1))
    a, b = simhash.local_links(fp, 4)
    assert len(a) <= len(fp) and np.all(np.isin(b, fp)) and np.all(np.bitwise_count(a ^ b) <= 4)


def test_near_duplicates_of_a_table_match_all_pairs(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fp = np.array([brute_fingerprint(r.text) for r in rows], np.uint64)
    root = components(len(rows), lambda i: np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4).tolist())
    least = {}
    for r, k in zip(rows, root):
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash_near_dedup(spark, sf).collect()}
    assert got == {r.doc_id: (f"{int(x):016x}", least[k]) for r, x, k in zip(rows, fp, root)}


# 3


def first_fit_decreasing(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        k = next((i for i, f in enumerate(free) if f >= n), None)
        if k is None:
            free.append(capacity - n)
        else:
            free[k] -= n
    return len(free)


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    rows = ODD + [(100 + i, " ".join(rng.choice(["alpha", "Beta,", "it's", "x1y22", "naïve", "—"]) for _ in range(rng.randint(0, 900)))) for i in range(60)]
    got = packing.pack(docs(spark, rows), word_bpe, 512, keep_ids=True).collect()
    plain = Tokenizer.from_file(word_bpe())
    want = Counter()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for k, lo in enumerate(range(0, len(ids), 512)):
            part = ids[lo : lo + 512]
            want[(i, k, lo, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part))] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 512
    assert len(by) <= first_fit_decreasing([r.length for r in got], 512)
    assert packing.pack(docs(spark, []), word_bpe).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plans_use_up_the_histogram(seed):
    rng = random.Random(seed)
    have = Counter(rng.choice([rng.randint(1, 4096), rng.randint(1, 300)]) for _ in range(rng.choice([3, 500, 5000])))
    plans = packing.plan(dict(have), 4096)
    used = Counter()
    for times, own in plans:
        assert sum(own) <= 4096
        used.update({k: v * times for k, v in Counter(own).items()})
    assert used == have
    assert sum(t for t, _ in plans) <= first_fit_decreasing(list(have.elements()), 4096)


def test_exact_complements_of_two_and_three():
    count = np.zeros(101, np.int64)
    count[[10, 20, 30]] = 1
    sums = packing.Sums(count)
    assert sums.exact(50) == [30, 20] and sums.exact(60) == [30, 20, 10]
    assert sums.exact(20) == [20] and sums.exact(90) is None and sums.exact(40) == [30, 10] and sums.exact(0) is None
    count[[10, 30]] = 0
    assert sums.exact(40) is None and sums.exact(60) is None


@pytest.mark.parametrize("seed", range(4))
def test_the_sum_index_finds_what_all_combinations_have(seed):
    from itertools import combinations

    rng = random.Random(seed)
    count = np.zeros(61, np.int64)
    for _ in range(25):
        count[rng.randint(1, 60)] += 1
    sums = packing.Sums(count)
    while count.any():
        have = [a for a in range(61) for _ in range(int(count[a]))]
        exact = {sum(c) for k in (1, 2, 3) for c in combinations(have, k)}
        for gap in rng.sample(range(1, 181), 60):
            found = sums.exact(gap)
            assert (found is not None) == (gap in exact)
            assert found is None or sum(found) == gap and not Counter(found) - Counter(have)
        count[rng.choice(have)] -= 1


def test_special_tokens_are_as_the_tokenizer_has_them():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(word_bpe())
    for t in ["a <|endoftext|> b", "a<|startoftext|>", "<|ENDOFTEXT|> x", "<| endoftext |>", "a < | b", "no tokens"]:
        want = plain.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(packing.coder(word_bpe()).encode([t])[0], "<u4").tolist() == want, t


# 4

_KEYWORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
SECRET = [("assign", re.compile(rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6), ("access", re.compile("(AKIA[A-Z0-9]+)()"), 20), ("hex", re.compile("([0-9a-f]+)()"), 24)]


def brute_secrets(text):
    out = []
    for k, (name, p, least) in enumerate(SECRET):
        out += [(m.start(), k, m.end()) for m in p.finditer(text or "") if len(m[2] if name == "assign" else m[1]) >= least]
    return sorted(out)


def test_secrets_match_brute_force(spark):
    rng = random.Random(2)
    parts = ["password", "Token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abcdef", "AKIA", "A1B2C3D4", "0123456789abcdef", "é", "😀", "a", "x/y", "\n", "secret"]
    rows = [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))) for i in range(800)] + ODD
    got = defaultdict(list)
    for r in secrets.scan(docs(spark, rows)).collect():
        got[r.doc_id].append(r)
    names = [n for n, _, _ in SECRET]
    for i, t in rows:
        spans = brute_secrets(t)
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        want = (*(sum(k == j for _, k, _ in spans) for j in range(3)), hashlib.sha256(text.encode()).hexdigest())
        same = [r for r in got[i] if (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == want]
        assert same, (i, t)
        assert set(text.split(",")) - {""} <= set(same[0].spans.split(","))
    assert sum(map(len, got.values())) == len(rows)
    assert secrets.scan(docs(spark, [])).count() == 0


def test_owner_specific_values_are_live_and_copied_ones_examples(spark):
    rows = [(i, "password=copied123", f"o{i}/r") for i in range(5)] + [(9, "token: onlyours77", "o9/a"), (10, "token: onlyours77", "o9/b"), (11, "see Zx81abCDefGHij2233kkLLmm ok", "o1/r"), (12, "see Common9abCDefGHij2233kkLL", "o1/r"), (13, "see Common9abCDefGHij2233kkLL", "o2/r")]
    got = {r.doc_id: r for r in secrets.scan(docs(spark, rows)).collect()}
    assert got[0].n_example == 1 and got[0].n_live == 0
    assert got[9].n_live == got[10].n_live == 1
    assert got[11].spans == "generic:4:28" and got[12].spans == ""
    assert (got[0].classes, got[0].repositories, got[9].classes, got[9].repositories, got[11].classes) == ("example", 5, "live", 2, "live")


def test_rows_without_a_repository_are_owners_of_their_own(spark):
    rows = [(i, "password=copied123", None) for i in range(6)] + [(9, "password=single999", None), (9, "password=single999", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.scan(table).collect()}
    assert (got[0].n_live, got[0].n_example, got[0].repositories) == (0, 1, 6) and (got[9].n_live, got[9].classes) == (1, "live")


# 5


def test_next_documents_and_edited_texts_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(1000 - 7 * i, " ".join(rng.choice(["red", "green", "blue", "ñandú", "cyan", "grey", "pink", "teal"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 80)))) for i in range(130)] + [(-5, None), (5000, "😀" * 9), (5001, rows_text := "same text here"), (5002, rows_text)]
    imatch_rows, imatch.NEIGHBOURS = imatch.NEIGHBOURS, 10
    try:
        got = {r.doc_id: r for r in imatch.fingerprints(docs(spark, rows)).collect()}
    finally:
        imatch.NEIGHBOURS = imatch_rows
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        g = got[i]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    assert got[5001].fingerprint == got[5002].fingerprint and got[5001].near_next == 1.0


def test_fingerprints_of_odd_tables(spark):
    got = imatch.fingerprints(docs(spark, ODD)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ODD)
    assert len({r.fingerprint for r in got if r.n_chars == 3 and r.doc_id == 4}) == 2
    assert imatch.fingerprints(docs(spark, [])).count() == 0
    one = imatch.fingerprints(docs(spark, [(7, "just one row")])).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"just ojust o").hexdigest() and one.near_next == 1.0


# 6


def brute_hits(texts, items):
    fold = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(fold))
    grams = defaultdict(set)
    for name, t in items:
        w = words(t)
        k = min(8, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            grams[tuple(w[p : p + k])].add(str(name))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for p in range(len(w) - k + 1):
                if names := grams.get(tuple(w[p : p + k])):
                    found |= names
                    hit |= set(range(p, p + k))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


@pytest.mark.parametrize("limit", [2_000_000, 30])
def test_decontamination_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", limit)
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["Aa", "b", "c'd", "é", "e1", "F"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 3, 7, 8, 9, 20]))) for i in range(12)] + [(50, None), (51, "..."), (None, "a b c d e f g h")]
    rows = [(100 + i, text(rng.randint(0, 60)) + " " + rng.choice(items)[1].__str__()) for i in range(60)] + ODD
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontam.scan(docs(spark, rows), bench).collect()
    want = brute_hits([t for _, t in rows], [(i, t) for i, t in items if i is not None])
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, want))
    kept = decontam.keep_clean(docs(spark, rows), bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for (i, _), w in zip(rows, want) if not w[2])
    assert decontam.scan(docs(spark, []), bench).count() == 0
    assert {r.n_items for r in decontam.scan(docs(spark, ODD), bench.limit(0)).collect()} == {0}


def test_suffix_arrays_and_longest_matches(spark):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50):
        x = rng.integers(0, 3, n)
        assert decontam.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    r = decontam.scan(docs(spark, [(1, "x y b c d e f g h i j k q")]), bench).collect()[0]
    assert (r.longest, r.longest_at, r.longest_item, r.n_hit) == (10, 2, "1", 10)


@pytest.mark.parametrize("part", [1 << 20, 7])
def test_longest_matches_with_shared_windows_match_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(decontam, "MATCHES", part)
    rng = random.Random(13)
    stock = [rng.choice("abc") for _ in range(14)]
    items = [(i, [*stock[: rng.randint(8, 14)], *(rng.choice("abc") for _ in range(rng.randint(0, 6)))]) for i in range(9)]
    rows = [(i, [*(rng.choice("abc") for _ in range(rng.randint(0, 5))), *rng.choice(items)[1], *(rng.choice("abc") for _ in range(5))]) for i in range(30)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.scan(docs(spark, [(i, " ".join(w)) for i, w in rows]), bench).collect()}
    for i, w in rows:
        runs = {(p, k): n for p in range(len(w)) for k, (_, v) in enumerate(items) for q in range(len(v) - 7) if (n := next((n for n in range(min(len(w) - p, len(v) - q), 7, -1) if w[p : p + n] == v[q : q + n]), 0))}
        assert got[i].longest == max(runs.values(), default=0)
        assert got[i].longest == 0 or got[i].longest_at == min(p for (p, _), n in runs.items() if n == got[i].longest)


# 7

PERSONAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute_personal(text):
    out = []
    for k, (kind, p) in enumerate(PERSONAL.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((k, m.start(), m.end()))
    return out


def test_personal_spans_match_brute_force():
    rng = random.Random(7)
    parts = ["@", "a", "b.c", "1", "22", "255", "256", ".", "-", " ", "+", "(", ")", "_", "4111111111111111", "1.2.3.4", "x@y.z", "é", "+1 (555) 555-1234"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute_personal(t), t
    assert pii.base_spans("1" * 6000 + "." + "2" * 6000) == []


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [(i, f"text {i} before you write mail to user{i}@host{i}.example.com today") for i in range(12)]
    rows = seeds + [(50, "before you write mail to user77@localhost today"), (51, "the year 2024 was fine"), (52, "random 99887766 code"), *ODD]
    got = defaultdict(list)
    for r in pii.find(docs(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert got[50][0].spans == "email:25:41" and got[50][0].n_email == 0
    assert got[51][0].spans == got[52][0].spans == ""
    for i, t in rows:
        base = ",".join(f"{list(PERSONAL)[k]}:{a}:{b}" for k, a, b in brute_personal(t))
        assert hashlib.sha256(base.encode()).hexdigest() in {r.base_sha256 for r in got[i]}
    assert sum(map(len, got.values())) == len(rows)
    assert pii.find(docs(spark, [])).count() == 0
    masked = {r.doc_id: r.text for r in pii.redact(docs(spark, rows)).collect()}
    assert masked[50] == "before you write mail to [EMAIL] today" and masked[3] == "   \n\t " and masked[1] is None


def test_overlapping_spans_are_masked_once():
    assert pii.masked("a 1.2.3.4 b", [(1, 2, 9)]) == "a [IP] b"
    assert pii.masked("0123456789", [(2, 1, 6), (3, 4, 8)]) == "0[CARD]89"
    assert pii.masked("abcdef", [(0, 0, 3), (1, 3, 6)]) == "[EMAIL][IP]"


# 8, 10


def labelled_rows(spark, rng, make, n=240):
    rows = [(i, make(i % 2, rng)) for i in range(n)]
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(n)] + [(None, 1, "x"), (9999, None, "x")], "doc_id long, y int, text string")
    return docs(spark, rows), labels


def test_quality_learns_held_out_rows_and_scores_odd_ones(spark):
    def make(y, rng):
        words = [rng.choice(["sun", "moon", "star", "sky", "cloud", "rain"]) + rng.choice(["", "ny", "s"]) for _ in range(rng.randint(3, 60))]
        return " ".join(words) if y else " ".join(w + "%%%" for w in words) if rng.random() < 0.5 else " ".join([words[0]] * 30)

    table, labels = labelled_rows(spark, random.Random(8), make)
    model = quality.train(table, labels, lambda c: F.crc32(c.cast("string").cast("binary")) % 4 != 2, label="y")
    got = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and sum((got[i] >= 0.5) == (i % 2) for i in held) >= 0.95 * len(held)
    odd = quality.score(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and len({r.score for r in odd if r.doc_id in (1, 2, 3)}) == 1 and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(docs(spark, []), model).count() == 0
    assert quality.train(docs(spark, []), labels, lambda c: F.lit(True), label="y")[1] == 0


def test_toxicity_tags_words_and_documents(spark):
    calm = ["sun", "moon", "star", "sky", "cloud", "rain", "tree", "leaf"]

    def make(y, rng):
        words = [rng.choice(calm) + str(rng.randint(0, 30)) for _ in range(rng.randint(20, 60))]
        for _ in range(4 * y):
            words.insert(rng.randint(0, len(words)), rng.choice(["Grubby", "vile", "nasty"]))
        return " ".join(words) + "."

    table, labels = labelled_rows(spark, random.Random(10), make)
    model = toxicity.train(table, labels, lambda c: F.crc32(c.cast("string").cast("binary")) % 5 != 0, label="y")
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and sum((got[i].score >= 0.5) == (i % 2) for i in held) >= 0.95 * len(held)
    texts = {r.doc_id: r.text for r in table.collect()}
    spans = {texts[1][s.start : s.end].lower() for s in got[1].spans}
    assert spans and spans <= {"grubby", "vile", "nasty"}
    odd = toxicity.score(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and len({r.score for r in odd if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(docs(spark, []), model).count() == 0
    kept = toxicity.keep_clean(table, model)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}


def test_toxicity_trains_in_a_task_and_not_on_the_driver(spark, monkeypatch):
    import pyarrow as pa

    def make(y, rng):
        words = [rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(20, 60))]
        for _ in range(4 * y):
            words.insert(rng.randint(0, len(words)), rng.choice(["GRUBBY", "vile", "nasty"]))
        return ". ".join(words)

    table, labels = labelled_rows(spark, random.Random(14), make)
    rows = sorted(((str(r.doc_id), r.text, r.y) for r in table.join(labels, "doc_id").collect()))
    each = [toxicity.words_of(toxicity.tokens(pa.array([text], pa.large_string()), words_only=True)) for _, text, _ in rows]
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(w.word) for w in each])
    upper = np.uint64(0xFFFFFFFF00000000)
    words = toxicity.Words(doc, *(np.concatenate([getattr(w, k) for w in each]) for k in ("sentence", "word")), [np.concatenate([w.stems[k] for w in each]) & upper for k in range(len(toxicity.STEMS))], np.concatenate([w.capital for w in each]))
    want = toxicity.train_crf(words, np.array([y for _, _, y in rows]) == 1)

    def never(*_):
        raise AssertionError("trained on the driver")

    monkeypatch.setattr(toxicity, "train_crf", never)
    got = toxicity.train(table, labels, lambda c: F.lit(True), label="y")
    assert want.capital != 0 and np.array_equal(got.weight, want.weight) and np.array_equal(got.move, want.move)
    assert (got.bias, got.capital, got.level) == (want.bias, want.capital, want.level)
    for few in (docs(spark, []), docs(spark, [(1, None), (2, "")])):
        none = toxicity.train(few, labels, lambda c: F.lit(True), label="y")
        assert not none.weight.any() and none.level == (-4.0, 1.0)


def test_driver_gives_native_memory_back(spark, monkeypatch):
    from kinfold.llm import memory

    if not hasattr(memory.ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("no glibc")
    assert memory.trim_jvm(spark).startswith("Trim native heap")
    said = []
    monkeypatch.setattr(memory, "trim_jvm", said.append)
    memory.driver_gives_back(spark)
    assert said == [spark]


def test_forward_backward_matches_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    score, move = rng.normal(size=7), rng.normal(size=(2, 2))
    first, size = np.array([0, 4]), np.array([4, 3])
    marginal, moves, z = toxicity.forward_backward(score, first, size, move)
    total, want, pairs = 0.0, np.zeros(7), np.zeros((2, 2))
    for lo, n in zip(first, size):
        weights = {}
        for y in itertools.product((0, 1), repeat=n):
            weights[y] = np.exp(sum(score[lo + i] * v for i, v in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:])))
        part = sum(weights.values())
        total += np.log(part)
        for y, w in weights.items():
            want[lo : lo + n] += np.array(y) * w / part
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w / part
    assert np.allclose(marginal, want) and np.allclose(moves, pairs) and np.isclose(z, total)
    for words in (1, 3, 5, 100):
        again, both = toxicity.by_blocks(score, first, size, move, words)
        assert np.allclose(again, want) and np.allclose(both, pairs)


@pytest.mark.parametrize("block", [2, 3, 7, 50])
def test_long_chains_are_tagged_whole(monkeypatch, block):
    rng = np.random.default_rng(3)
    size = np.array([1, 9, 40, 3, 101])
    score, move = 3 * rng.normal(size=size.sum()), rng.normal(size=(2, 2))
    first = np.cumsum(size) - size
    want = toxicity.forward_backward(score, first, size, move)
    monkeypatch.setattr(toxicity, "LONG", block)
    got = toxicity.forward_backward(score, first, size, move)
    assert all(np.allclose(a, b) for a, b in zip(got, want))


def brute_toxicity(text, m):
    """Score of one document by sums over matrices, word by word, for hashes as the tokenizer has them."""
    import pyarrow as pa

    t = toxicity.tokens(pa.array([text], pa.large_string()), words_only=True)
    words = re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text)
    assert len(words) == len(t.hash)
    w = toxicity.words_of(t)
    evidence, at = 0.0, 0
    for sentence in [s for s in re.split("[\n!.?]", text) if re.search("[0-9A-Za-z\x80-\U0010ffff]", s)]:
        n = len(re.findall("[0-9A-Za-z\x80-\U0010ffff]+", sentence))
        score = [m.bias + m.capital * w.capital[i] + sum(float(m.weight[f[i]]) for f in w.features()) for i in range(at, at + n)]
        step = lambda i: np.exp(m.move) * np.array([1.0, np.exp(score[i])])[None, :]
        ahead = [np.array([1.0, np.exp(score[0])])]
        for i in range(1, n):
            ahead.append(ahead[-1] @ step(i))
        back = [np.ones(2)]
        for i in range(n - 1, 0, -1):
            back.insert(0, step(i) @ back[0])
        evidence += sum((a[1] * b[1] / ahead[-1].sum()) ** 2 for a, b in zip(ahead, back))
        at += n
    return 1 / (1 + np.exp(-(m.level[0] + m.level[1] * np.log1p(20 * evidence))))


def test_toxicity_generalises_to_unseen_spellings_and_matches_brute_force(spark):
    rng = random.Random(12)
    ends = [a + b for a in "bcdfglmnprst" for b in "aeiou"]

    def make(y, r):
        words = [r.choice(["sun", "moon", "star", "sky", "cloud", "rain"]) + r.choice(ends) for _ in range(r.randint(20, 50))]
        for _ in range(5 * y):
            words.insert(r.randint(0, len(words)), "grubbo" + r.choice(ends[:40]))
        return " ".join(words) + "."

    table, labels = labelled_rows(spark, rng, make, 300)
    model = toxicity.train(table, labels, lambda c: F.lit(True), label="y")
    fresh = [(1, "the sunny moon grubbo" + ends[50] + " and grubbo" + ends[55] + " rain"), (2, "the sunny moon and rain"), (3, "A b.\nsun GRUBBOX sky! " * 5), (4, "")]
    got = {r.doc_id: r for r in toxicity.score(docs(spark, fresh), model).collect()}
    assert got[1].score >= 0.5 and got[2].score < 0.5 and [(s.start, s.end) for s in got[1].spans] == [(15, 23), (28, 36)]
    for i, text in fresh[:3]:
        assert abs(got[i].score - brute_toxicity(text, model)) < 1e-5


def test_samples_are_bounded_and_deterministic(spark):
    table = docs(spark, [(i, "t") for i in range(100)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(3, 0)], "doc_id long, y int")
    a = labelled.sample(table, labels, "y", lambda c: F.lit(True), 10).collect()
    assert len(a) == 20 and sorted(map(str, a)) == sorted(map(str, labelled.sample(table.repartition(7), labels, "y", lambda c: F.lit(True), 10).collect()))


# 9


def test_licences_are_named_and_near_misses_are_not(spark):
    rows = [
        (1, "prose\nReleased under the MIT License.\nmore"),
        (2, "Licensed under the Apache License, Version 2.0."),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0."),
        (5, "The driver showed his licence to the permission office."),
        (6, "a text of no licence at all"),
        (7, LONG + "\nReleased under the MIT License."),
        *ODD,
    ]
    got = defaultdict(list)
    for r in licences.scan(docs(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert [got[i][0].families for i in (1, 2, 3, 7)] == ["mit", "apache", "gpl", "mit"]
    assert "cc-by-nc" in got[4][0].families.split(",")
    assert got[5] and any(r.families == "" and r.n_unknown == 1 for r in got[5]) and got[6][-1].families == ""
    assert sum(map(len, got.values())) == len(rows)
    assert licences.scan(docs(spark, [])).count() == 0


def brute_paragraphs(text):
    text = re.sub(r"(?<=[.:!?\"])[ \t\r]*\n", "\n\n", text or "")
    return re.split(r"\n[ \t\r]*\n\s*", text)


def brute_licences(text):
    m, families, unknown, most = licences.model(), [], 0, None
    for p in brute_paragraphs(text):
        words = licences._words(p)
        chance = m.probabilities(words)
        best = max(range(len(chance)), key=lambda k: chance[k])
        family, good = m.names[best], False
        if family != "unknown" and chance[best] >= m.sure:
            for t in licences.NOTICES[family]:
                own = set(licences._words(t))
                if not (own & set(licences._NAMES)) - set(words):
                    good |= len(own & set(words)) >= licences.CONFIRM * min(len(own), len(set(words)))
        if good:
            families.append(family)
            most = max(most or 0, chance[best])
        elif re.search(licences.TRIGGER, p):
            unknown += 1
    return ",".join(sorted(set(families))), len(families), unknown, most


def test_scans_match_brute_force(spark):
    rng = random.Random(15)
    stock = [t for texts in licences.NOTICES.values() for t in texts] + list(licences.OTHERS) + list(licences.HELD_OUT) + ["Thth onre in the heon.", "of no use", "Copyright 2021 Jane Doe", "unlicensed", ""]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            words = rng.choice(stock).split(" ")
            words = [w for w in words if rng.random() > 0.05]
            wrap = rng.randint(4, 12)
            parts.append("\n".join(" ".join(words[k : k + wrap]) for k in range(0, len(words), wrap)))
        rows.append((i, rng.choice(["\n", "\n\n", "\n \t\n"]).join(parts)))
    got = {r.doc_id: r for r in licences.scan(docs(spark, rows)).collect()}
    for i, t in rows:
        families, n, unknown, most = brute_licences(t)
        r = got[i]
        assert (r.families, r.n_licence, r.n_unknown) == (families, n, unknown), t
        assert (r.probability is None) == (most is None) and (most is None or abs(r.probability - most) < 1e-5)


def test_whole_table_scan_matches_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: (r.families, r.n_licence, r.n_unknown) for r in op9_licence_scan(spark, sf).collect()}
    assert got == {r.doc_id: brute_licences(r.text)[:3] for r in rows} and any(n for _, n, _ in got.values())


def test_licence_model_knows_its_notices_and_refuses_others():
    m = licences.model()
    best = lambda t: max(zip(m.probabilities(licences._words(t)), m.names))[1]
    assert all(best(t) == k for k, texts in licences.NOTICES.items() for t in texts)
    assert all(best(t) == "unknown" for t in licences.OTHERS)
    found = [t for t in licences.HELD_OUT if brute_licences(t)[0]]
    assert not found
    for text, family in [("EPL-2.0 licensed", "epl"), ("Released under the Unlicense License.", "unlicense"), ("MIT-like Foo License", ""), ("Licensed under the AGPL-3.0", "agpl"), ("Licensed under the LGPL, version 3.", "lgpl"), ("Unwarranted claims abound", "")]:
        assert brute_licences(text)[0] == family, text
