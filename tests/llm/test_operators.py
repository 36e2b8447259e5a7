"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import bitslice, encoders, lm, mixing, packing, pii, pivots, queries, secrets, shingles, simhash, token_orc, toxicity
from graphloom.llm import attention as A
from graphloom.llm.common import connected_components, shared_dir
from graphloom.llm.spans import find_spans

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _hash string, score double"


def rows():
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today "
    texts = [None, "", "one", "Two words", base * 3, base * 3, base * 3 + "x", "AKIA" + "A" * 20 + " token = abcdef1", "mail a.b@c.org " + base, "α β  γ\n\tδ  x", "z" * 40_000, base * 2_000]
    return [(None if i == 3 else i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, "h", 0.1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 10), (5, 5), (None, 4)], "a long, b long")
    assert {tuple(r) for r in connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (10, 1), (8, 8), (9, 8)}
    assert connected_components(e.limit(0)).count() == 0


def test_components_around_hubs(spark, monkeypatch):
    from graphloom.llm import common

    monkeypatch.setattr(common, "HUB", 20)
    rng = np.random.default_rng(2)
    pairs = {(7, int(x)) for x in range(1000, 3000)} | {(int(a), int(b)) for a, b in rng.integers(0, 3000, (600, 2))}
    root = list(range(3000))
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(list(pairs), "a long, b long")).collect()}
    assert all(got.get(i, i) == r for i, r in enumerate(root))


@pytest.mark.parametrize(("kind", "name"), [(encoders.SpacedEncoder, "byte_bpe_50k.json"), (encoders.WordEncoder, "word_bpe_49k.json")])
def test_encoders_equal_the_library(kind, name):
    e, rng = kind(public_tokenizers.path(name)), np.random.default_rng(3)
    parts = ["the", "ErSt.", "Ünïß", "Œ×ç", "foo's", "it", "ab,&&", "İx", "xŉ", " ", "  ", "\n", "\t", "a", "B", "é", "'s", "1", ".", "…", "世", "\x0b", "\x1c", "́", "Σ", "İ", "<|endoftext|>", "\x01", " '", " "]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(6000)]
    assert e.encode(texts) == e.library(texts)
    spaced = [" ".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(6000)]
    assert e.encode(spaced) == e.library(spaced) == e.encode(spaced)


def simhash_of(t):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert Counter(r.fingerprint for r in got) == Counter(f"{simhash_of(x[1]):016x}" for x in rows())
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    fp = {x[0]: simhash_of(x[1]) for x in rows() if x[0] is not None}
    links = {a: {b for b in fp if bin(fp[a] ^ fp[b]).count("1") <= 3} for a in fp}
    for a in fp:
        seen, todo = set(), [a]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += links[x]
        assert by[a] == min(seen)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_finds_all_close_fingerprints(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base for n in (1, 2, 3)]
    fps = sorted({int(np.int64(np.uint64(x).view(np.int64))) for x in [*base, *near]})
    roots = {r.node: r.root for r in connected_components(simhash.link_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
    u = np.array(fps, np.int64).view(np.uint64)
    for i, a in enumerate(u):
        for j in np.flatnonzero(np.bitwise_count(u ^ a) <= 3):
            assert roots.get(fps[i], fps[i]) == roots.get(fps[j], fps[j])


def test_token_orc_round_trip(spark, docs, empty):
    path, t = shared_dir(spark), public_tokenizers.path("byte_bpe_50k.json")
    token_orc.write_token_orc(docs, path, t)
    lib = Tokenizer.from_file(t)
    got = token_orc.read_token_orc(spark, path).orderBy("start").collect()
    want = sorted(rows(), key=lambda x: (x[0] is not None, x[0]))
    at = 0
    for r, x in zip(got, want, strict=True):
        ids = lib.encode(x[1] or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (x[0], at, len(ids), ids)
        at += len(ids)
    crc = {r.doc_id: r.ids_crc32 for r in token_orc.digest(spark, path).collect()}
    assert all(crc[r.doc_id] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert [r.doc_id for r in token_orc.lookup(spark, path, [6]).collect()] == [6]
    token_orc.write_token_orc(empty, path + "-empty", t)
    assert token_orc.read_token_orc(spark, path + "-empty").count() == 0


def test_packing(docs, empty):
    t = public_tokenizers.path("word_bpe_49k.json")
    lib, got = Tokenizer.from_file(t), packing.pack(docs, t).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for x in rows():
        ids, at = lib.encode(x[1] or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(by[x[0]], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and list(np.frombuffer(r.ids, "<u4")) == ids[at : at + r.length]
            at += r.length
        assert at == len(ids)
    pad, total = 0, 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        total, pad = total + at, pad + (0 if at & (at - 1) == 0 else 4096 - at)
    assert pad == 0 < total
    assert packing.pack(empty, t).count() == 0


@pytest.mark.parametrize("capacity", [8, 100, 4096])
def test_harmonic_bins(capacity):
    rng = np.random.default_rng(capacity)
    docs = [np.full(n, i, "<u4") + (np.arange(n, dtype="<u4") << 12) for i, n in enumerate(np.minimum(rng.zipf(1.3, 3000), 3 * capacity))]
    bins = packing.Harmonic(capacity)
    for i, d in enumerate(docs):
        bins.add(i, d.tobytes())
    early = len(bins.closed)
    assert sum(w[1] for w in bins.waiting) == bins.room < 2 * capacity
    bins.finish()
    parts = defaultdict(list)
    for no, b in enumerate(bins.closed):
        n = sum(p[2] for p in b)
        assert n == capacity or (no >= early and n < capacity and n & (n - 1) == 0)
        for doc, start, length, total, ids in b:
            assert total == len(docs[doc]) and length * 4 == len(ids)
            parts[doc].append((start, ids))
    assert all(b"".join(ids for _, ids in sorted(parts[i])) == d.tobytes() for i, d in enumerate(docs))
    whole = sum(len(p) == 1 for i, p in parts.items() if len(docs[i]) <= capacity)
    assert whole >= 0.7 * sum(len(d) <= capacity for d in docs)


def test_secrets(spark, docs, empty):
    shown = "dG9rZW4/Q2hhbmdl-7Xy_Zp0 key"
    extra = [(50 + i, f"password: hunter22 {shown} deadbeef" + "0" * 20 + " token=token:abcdefgh", "en", f"o{i}", 0, "", 0.0) for i in range(2)]
    many = [(60 + i, "Secret='copied-secret' pQ7/w3Er_T9yU1iO0pAs key" + "q" * 30, "en", f"o{i}", 0, "", 0.0) for i in range(4)]
    all_rows = rows() + extra + many
    d = spark.createDataFrame(all_rows, DOCS)
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(d)).collect()}
    checks = [("assign", secrets.ASSIGN, lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    for x in all_rows:
        spans = sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(checks) for m in re.finditer(p, x[1] or "") if ok(m))
        assert got[x[0]].base_sha256 == hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in spans).encode()).hexdigest()
    assert "keylike:" in got[50].spans and got[50].n_live >= 1
    assert "keylike:" not in got[60].spans and got[60].n_copied == 1
    # ownership by its definition
    held = defaultdict(list)
    for r in secrets.candidates(d).collect():
        for c in r.cands:
            held[c.h].append((r.owner, r.repo))
    every = {x[3] for x in all_rows}
    for r in secrets.scan(d).collect():
        for x in r.spans:
            owners, repos = {o for o, _ in held[x.h]}, set(held[x.h])
            assert (x.n_owners, x.n_repos, x.n_found) == (len(owners), len(repos), len(held[x.h]))
            assert x.live == (len(owners) + (len(repos) - len(owners)) / 2 < max(3, 0.01 * len(every)))
    assert secrets.scan(empty).count() == 0


def test_spans(spark):
    d = spark.createDataFrame([("aXbX",), ("",), ("XX",), ("é€X",)], "t string")
    assert [[(x.s, x.e) for x in r[0]] for r in d.select(find_spans(F.col("t"), "X")).collect()] == [[(1, 2), (3, 4)], [], [(0, 1), (1, 2)], [(2, 3)]]


def test_pii(spark, docs, empty):
    texts = ["Mail John.Doe@Acme.co.uk or john.doe@acme.co.uk, +1 (212) 555-0199", "Mrs. Anna Schmidt and Mr. Müller, 10.2.33.4", "Card 4111 1111 1111 1111 = 4111111111111111", "version 2.0. of 1.2.3 in 2024", None, "Иван Петров, Mrs. Anna Schmidt"]
    d = spark.createDataFrame([(i, t, "en", "s", 0, "h", 0.0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in pii.anonymise(d).collect()}
    assert got[3].text == texts[3] and got[4].text is None and got[3].n_entities == 0
    mails = re.findall(r"\S+@\S+\w", got[0].text)
    assert len(mails) == 2 and mails[0].lower() == mails[1] and "doe" not in got[0].text.lower() and mails[0].endswith(".uk")
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}$", got[0].text) and "0199" not in got[0].text
    women = [x.lower() for x in pii.FEMALE_GIVEN]
    found = [re.search(r"Mrs\. (\S+ \w+)", got[i].text)[1] for i in (1, 5)]
    assert found[0] == found[1] and found[0].split()[0].lower().split("-")[0] in women and got[5].text.split()[0] in pii.MALE_CYRILLIC
    a, b = re.findall(r"\d[\d ]{14,17}\d", got[2].text)[:2]
    assert a.strip().replace(" ", "") == b.strip() != "4111111111111111" and a.strip().count(" ") == 3
    again = {r.doc_id: r.text for r in pii.anonymise(d).collect()}
    assert again == {k: r.text for k, r in got.items()}
    out = {(r.doc_id, r.text) for r in pii.anonymise(docs).collect()}
    assert len(out) == 12 and (1, "") in out and pii.anonymise(empty).count() == 0
    assert pii.anonymise(spark.createDataFrame([(1, "a@b.org")] * 3, "doc_id long, text string")).count() == 3


def luhn(t):
    d = [int(c) for c in t if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def iban_ok(t):
    t = t.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def test_pii_keeps_coreference_and_check_digits(spark):
    t = "Mr. John Doe met Mr. Doe, Anna Smith and Ms. Smith. 4111 1111 1111 1111, 4111111111111112, DE89 3704 0044 0532 0130 00"
    d = spark.createDataFrame([(1, t, 5, 6)], "doc_id long, text string, __pii_hash int, n_entities int")
    r = pii.anonymise(d).first()
    m = re.match(r"Mr\. (\w+) (\w+) met Mr\. (\w+), (\w+) (\w+) and Ms\. (\w+)\. ([\d ]+), (\d+), ([A-Z0-9 ]+)$", r.text)
    assert m and m[2] == m[3] != m[5] == m[6] and r["__pii_hash"] == 5 and r.n_entities == 7
    assert not {"John", "Doe", "Anna", "Smith"} & set(m.groups())
    assert luhn(m[7]) and not luhn(m[8]) and iban_ok(m[9]) and m[7][:2] != "DE" and m[9][:2] == "DE" and m[9] != t[-27:]
    assert pii.anonymise(d, "another key").first().text != r.text == pii.anonymise(d, pii.KEY).first().text


def test_pii_hostile_texts(spark):
    texts = ["x@" + "b." * 2000 + "1", "a." * 40_000 + "@b.org", "9" * 200_000, "A" * 200_000, "+1 " * 60_000, "Mr. " + "Q" + "q" * 100_000, "1-" * 100_000, "DE89 " * 40_000, "a@" * 50_000, "@".join(["a.b"] * 40_000)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.anonymise(d).collect()}
    assert got.keys() == set(range(len(texts))) and got[0] == texts[0] and got[1] == texts[1] and got[5] == texts[5]


def test_pii_never_runs_out(spark):
    d = spark.createDataFrame([(i, f"Mr. X{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} a{i}@b.io") for i in range(1500)], "doc_id long, text string")
    got = [re.match(r"Mr\. (\S+) (\S+@\S+)$", r.text) for r in pii.anonymise(d).collect()]
    assert len({m[1] for m in got}) == 676 and len({m[2] for m in got}) == 1500
    names = spark.createDataFrame([("given", f"n{i}", "f") for i in range(600)], "kind string, norm string, gender string")
    assert len({r.new for r in pii.replacements(names).collect()}) == 600


def test_pii_spans_equal_a_search(spark):
    import regex

    rng = np.random.default_rng(5)
    parts = ["Mr. ", "Mrs. Anna ", "Doe", "Иван Петров", " ", ", ", "a.b@c.org", "x@y", "@", "10.2.3.4", ".", "-", "123-45-6789", "+1 (212) 555-0199", "DE89370400440532013000", "4111 1111 1111 1111", "7", "Anna", "é", "\n"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(1500)]
    found = pii.mentions(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").collect()
    got = defaultdict(list)
    for r in found:
        got[r.id].append((r.s, r.e))
        assert texts[r.id][r.s : r.e] == r.value
    for i, t in enumerate(texts):
        want = [(m.start(), m.end()) for m in regex.finditer(pii.ANY, t)]
        mine = sorted(got[i])
        assert all(any(s <= a and b <= e for s, e in want) for a, b in mine)
        assert all(any(s <= a and b <= e and b == e for a, b in mine) for s, e in want)


def test_pii_surrogates_stay_distinct(spark):
    n = 400
    d = spark.createDataFrame([(i, f"10.0.{i // 250}.{i % 250}") for i in range(n)], "doc_id long, text string")
    new = [r.text for r in pii.anonymise(d).collect()]
    assert len(set(new)) == n and not set(new) & {f"10.0.{i // 250}.{i % 250}" for i in range(n)}


def test_mixing(spark, empty):
    d = spark.createDataFrame([(i, "w " * (i % 40), "en", None if i % 7 == 0 else f"s{i % 4 if i % 3 else 0}", 0, "", 0.0) for i in range(600)], DOCS)
    src = {r.doc_id: r.source for r in d.collect()}
    got = mixing.mix(d).collect()
    total, taken, goal = Counter(), Counter(), {}
    for r in got:
        assert r.size == r.doc_id % 40 and r.taken == r.size * r.copies and r.copies <= 2 and len(r.shards) == r.copies
        total[r.source] += r.size
        taken[r.source] += r.taken
        goal[r.source] = r.target
        assert src[r.doc_id] == r.source
    order = sorted(total, key=lambda x: (x is None, x or ""))
    weight, full = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        want = {s: 2.0 * total[s] if s in full else left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        if not (over := {s for s in order if want[s] > 2 * total[s] + 1e-9} - full):
            break
        full |= over
    assert all(abs(want[s] - goal[s]) < 1e-6 and abs(taken[s] - want[s]) <= 20 for s in order)
    assert len({s for r in got for s in r.shards}) == mixing.SHARDS
    assert mixing.mix(empty).count() == 0


def test_splitting_tree_is_exact(spark):
    q = spark.createDataFrame([("a", 10), ("b", 3), (None, 7), ("c", 0)], "source string, quota long")
    tree = mixing.splitting_tree(q, shards=5).collect()
    by, per = Counter(), Counter()
    for r in tree:
        by[r.source] += r.n_blocks
        per[r.shard] += r.n_blocks
    assert by == {"a": 10, "b": 3, None: 7, "c": 0} and set(per.values()) == {4}


def test_splitting_tree_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 8)
    want = {f"s{i}": i % 7 for i in range(60)}
    q = spark.createDataFrame(list(want.items()), "source string, quota long")
    trees = [mixing.splitting_tree(q, shards=4, seed=s).collect() for s in range(12)]
    first = []
    for tree in trees:
        by, per, mine = Counter(), Counter(), defaultdict(list)
        for r in tree:
            by[r.source] += r.n_blocks
            per[r.shard] += r.n_blocks
            mine[r.source].append((r.shard, r.first_block, r.n_blocks))
        assert by == want and sum(per.values()) == sum(want.values()) and max(per.values()) - min(per.values()) <= 2
        for parts in mine.values():
            at = 0
            for _, start, n in sorted(parts):
                assert start == at
                at += n
        first += [r.n_blocks for r in tree if want[r.source] == 6]
    # a shard's share of six blocks is hypergeometric: mean 1.5, variance 6 * (1/4) * (3/4) and a little less
    assert np.mean(first) == pytest.approx(1.5) and 0.8 < np.var(first) < 1.4


def test_hypergeometric_draw_follows_its_distribution(spark):
    from math import comb

    d = spark.range(4000).select(mixing._draw(F.lit(20), F.lit(8), F.lit(5), (F.col("id") + 0.5) / 4000.0).alias("k"))
    got = Counter(r.k for r in d.collect())
    assert all(abs(got[k] / 4000 - comb(8, k) * comb(12, 5 - k) / comb(20, 5)) < 1e-3 for k in range(6))


def vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 16)).round(3)
    x[10:20] = x[9] + rng.normal(size=(10, 16)) * 0.02
    x[30] = x[31] = x[32]
    out = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)]
    return [*out, (60, None, 0, ""), (61, [0.0] * 16, 0, ""), (62, [float("nan")] * 16, 0, ""), (63, [None, 1.0], 0, ""), (64, [], 0, ""), (100, x[32].tolist(), 1, "")]


@pytest.fixture(scope="module")
def vecs(spark):
    return spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int, n string")


def valid():
    return {i: np.array(v) for i, v, *_ in vectors() if i < 60 or i == 100}


def scored():
    """Vectors that take part in inner products: the empty and the zero one, too."""
    return valid() | {61: np.zeros(16), 64: np.zeros(16)}


def test_pivots(vecs):
    got = {r.vec_id: r for r in pivots.near_duplicates(vecs).collect()}
    v = {i: x / np.linalg.norm(x) for i, x in valid().items()}
    links = {a: {b for b in v if a != b and v[a] @ v[b] >= 0.95} for a in v}
    assert {i: got[i].n_links for i in v} == {i: len(x) for i, x in links.items()}
    for a in v:
        seen, todo = set(), [a]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += links[x]
        assert got[a].component_id == min(seen) and got[a].kept == (a == min(seen))
    assert all(got[i].n_links == 0 and got[i].kept for i in (60, 61, 62, 63, 64))
    assert pivots.near_duplicates(vecs.limit(0)).count() == 0


def test_pivot_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y, p = 0.95 * x + np.sqrt(1 - 0.95**2) * z, rng.normal(size=(256, 64))
    a, b = (pivots.nearest_pivots(m, p / np.linalg.norm(p, axis=1, keepdims=True), pivots.NEAREST) for m in (x, y))
    assert np.mean([len(set(i) & set(j)) >= pivots.SHARED for i, j in zip(a, b, strict=True)]) >= 0.9


def hot_group(n, share, cosine=0.97, dims=64):
    """Unit vectors of which the first `share` are one group of near copies, at about `cosine` with each other."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hot = int(n * share)
    x[:hot] = np.sqrt(cosine) * x[n - 1] + np.sqrt(1 - cosine) * x[:hot]
    return x / np.linalg.norm(x, axis=1, keepdims=True), hot


@pytest.mark.parametrize("cosine", [0.97, 0.94, 0.8])
def test_pivot_recall_in_a_hot_group(cosine):
    x, hot = hot_group(10_000, 1 / 3, cosine)
    rng = np.random.default_rng(7)
    p = pivots.spread(x[rng.permutation(len(x))[: pivots.POOL * 128]], 128)
    z = rng.normal(size=(500, 64))
    a = x[:500]
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    copies = 0.955 * a + np.sqrt(1 - 0.955**2) * z
    near = pivots.nearest_pivots(np.concatenate([x[:hot], copies]), p, pivots.NEAREST)
    inside = near[: hot : hot // 300]
    share = lambda i, j: len(set(i) & set(j)) >= pivots.SHARED
    assert np.mean([share(i, j) for i, j in zip(near[:500], near[hot:], strict=True)]) >= 0.9
    if cosine >= 0.97:
        assert np.mean([share(i, j) for k, i in enumerate(inside) for j in inside[:k]]) >= 0.9


def test_pivots_link_a_hot_group(spark):
    x, hot = hot_group(1_500, 1 / 3)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in pivots.near_duplicates(d).collect()}
    assert sum(got.values()) >= 0.9 * want.sum() and all(got[i] <= w for i, w in enumerate(want))
    alone = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:100])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.n_links for r in pivots.near_duplicates(alone).collect()} == {i: int(w) for i, w in enumerate((x[:100] @ x[:100].T >= 0.95).sum(axis=1) - 1)}


def test_top_k(vecs):
    got = defaultdict(list)
    for r in bitslice.top_k(vecs, vecs.where("vec_id % 10 = 0")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    q = {i: np.floor(256 * x).astype(int) for i, x in scored().items()}
    assert got.keys() == {i for i in q if i % 10 == 0}
    for i, found in got.items():
        best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:5]
        assert sorted(found) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert bitslice.top_k(vecs.limit(0), vecs.limit(0)).count() == 0


def test_top_k_of_wide_components(spark):
    x = {0: [3.0, -2.0, 1e9], 1: [70_000.0, 1.0, 0.0], 2: [-1e12, 5.5, 1e12], 3: [1e14, 1e14, -1e14], 4: [], 5: [0.25], 6: [1e300, 0.0, 0.0], 7: [2.0**47] * 3}
    d = spark.createDataFrame([(i, v) for i, v in x.items()], "vec_id long, embedding array<double>")
    q = {i: [int(np.floor(256 * y)) for y in v] + [0] * (3 - len(v)) for i, v in x.items() if i != 6}
    got = defaultdict(list)
    for r in bitslice.top_k(d, d).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for i in q:
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i)[:5]
        assert sorted(got[i]) == [(k + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for k, (s, j) in enumerate(best)]


def test_signed_digits():
    assert all(sum(d << p for d, p in bitslice.digits(n)) == n for n in range(-300, 300))


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrst"), rng.integers(2, 8)))
    base = [word() for _ in range(500)]
    text = lambda bad: " ".join(rng.choice(base, 120).tolist() + (["stupidhead", "moronic", "worthless"] * 2 if bad else []))
    bad, good = [text(True) for _ in range(150)], [text(False) for _ in range(300)]
    m = toxicity.fit([toxicity.windows(t) for t in bad[:120]], [toxicity.windows(t) for t in good[:240]])
    assert (m.scores(bad[120:]) >= 0.5).mean() >= 0.9 and (m.scores(good[240:]) >= 0.5).mean() <= 0.1
    out = toxicity.score(docs, m).collect()
    assert len(out) == 12 and all(0 <= r.score <= 1 for r in out) and toxicity.score(empty, m).count() == 0
    assert sorted(toxicity.score(docs.withColumn("_text", F.lit(1)), m).columns) == sorted([*docs.columns, "_text"])
    nothing = toxicity.fit([], [])
    assert (nothing.scores(["", "a b"]) < 0.5).all()
    # a text's score by its definition: compressed lengths of all its windows under either dictionary
    for t in [*bad[:3], *good[:3], "", "one"]:
        words, total = t.lower().split(), 0.0
        for i in range(0, len(words), toxicity.WINDOW_WORDS):
            w = f" {' '.join(words[i : i + toxicity.WINDOW_WORDS])} ".encode()
            gain = len(toxicity._compressor(m.ordinary).compress(w)) - len(toxicity._compressor(m.toxic + m.ordinary).compress(w))
            total += (gain if gain >= m.least else 0) - m.rate
        assert m.scores([t])[0] == pytest.approx(1 / (1 + np.exp(-np.clip(total - m.bar, -30, 30))))


def test_toxicity_learns_from_labelled_rows(spark, docs, empty):
    d = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    one, two = toxicity.train(d, labels), toxicity.train(d.repartition(3), labels)
    assert one == two and one.ordinary
    held = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    assert toxicity.train(d, held) == toxicity.train(empty, labels) == toxicity.fit([], [])
    assert toxicity.train(docs, labels).toxic == b"" or docs.count()
    long = spark.createDataFrame([(1, "word " * 200_000, 1)], "doc_id long, text string, toxic int")
    assert len(toxicity.train(long, long.select("doc_id", "toxic")).toxic) <= toxicity.DICT_TOXIC


def streamed(*texts):
    return A.Stream(np.concatenate([np.zeros(0, np.int64), *texts]), np.array([len(t) for t in texts]))


def test_attention_gradients():
    rng = np.random.default_rng(0)
    logs = A.prior(rng.integers(0, 3, (A.VOCAB, A.VOCAB)).astype(float))
    m = A.Model({k: v.astype(np.float64) for k, v in A.initial().items()}, *[x.astype(np.float64) for x in logs])
    s = streamed(*[rng.integers(0, A.END, n) for n in (5, 40, 0, 17)])
    g = m.gradients(s)
    at = int(s.x[np.flatnonzero(s.real)[9]])
    for name, i in (("wc", (3, 4)), ("bias", (2, 9)), ("q", (at, 1)), ("k", (at, 1)), ("v", (at, 2)), ("u", (at, 0))):
        keep, sides = m.p[name][i], []
        for step in (1e-3, -1e-3):
            m.p[name][i] = keep + step
            sides.append(-m.log_probs(s).sum() / s.real.sum())
        m.p[name][i] = keep
        assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(float(g[name][i]), rel=0.02, abs=1e-7)


def test_attention_by_definition():
    """Each id against a plain loop: causal context of at most CONTEXT ids of the same text, one score an id."""
    rng = np.random.default_rng(1)
    m = A.Model(A.initial(), *A.prior(rng.integers(0, 3, (A.VOCAB, A.VOCAB)).astype(float)))
    texts = [rng.integers(0, A.END, n) for n in (50, 3, 0, 30)]
    s = streamed(*texts)
    got = m.log_probs(s)
    assert s.real.sum() == sum(len(t) + 1 for t in texts) and (got[~s.real] == 0).all()
    for t, start in zip(texts, s.starts, strict=True):
        x, y = [A.END, *t], [*t, A.END]
        for i in range(len(x)):
            low = max(0, i // A.STRIDE * A.STRIDE - A.STRIDE)
            z = np.array([m.p["q"][x[i]] @ m.p["k"][x[j]] / A.DIM**0.5 + m.p["bias"][i % A.STRIDE, j - (i // A.STRIDE * A.STRIDE - A.STRIDE)] for j in range(low, i + 1)])
            w = np.exp(z) / np.exp(z).sum()
            h = sum(w[j - low] * m.p["v"][x[j]] for j in range(low, i + 1)) + m.p["u"][x[i]]
            z = h @ m.p["wc"] + m.log_class[x[i]]
            assert got[start + i] == pytest.approx(z[y[i] // A.SIDE] - np.log(np.exp(z).sum()) + m.log_in[x[i], y[i]], abs=1e-4)
    total = sum(np.exp(m.log_probs(streamed(np.append(texts[0][:19], i)))[19]) for i in range(A.END)) + np.exp(m.log_probs(streamed(texts[0][:19]))[19])
    assert total == pytest.approx(1, abs=1e-3)


def test_lm_probabilities_add_up():
    """After any text, the mixed probabilities of all next ids sum to 1."""
    sub = lm.Subwords(public_tokenizers.path("byte_bpe_50k.json"))
    words = [b"there", b"then", b"the", b"zebra", b"thesis", b"ther"]
    sub.learn(words)
    counts = np.array([5, 3, 9, 1, 2, 2])
    rows = next(lm._inside(public_tokenizers.path("byte_bpe_50k.json"))([pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts)], names=["word", "c"])]))
    t = pa.Table.from_batches([rows]).group_by(["key", "before", "id"]).aggregate([("n", "sum"), ("ends", "sum")])
    cols = [t.column(c).to_numpy() for c in ("key", "before", "id", "n_sum", "ends_sum")]
    p = lm.Prefixes(cols[0].view(np.uint64), cols[1].view(np.uint64), *cols[2:], 4, sub.opens)
    assert p.first.sum() == pytest.approx(1)
    ids, n = sub.ids, sub.length
    num, total, ends = p.of(ids, n)
    for w in range(len(words)):
        for j in range(n[w]):
            at = sub.at[w] + j
            before = ids[sub.at[w] : at + 1].tolist()
            after = {tuple(x[: j + 2]): 0 for x in (ids[sub.at[k] : sub.at[k] + n[k]].tolist() for k in range(len(words))) if x[: j + 1] == before and len(x) > j + 1}
            for k in range(len(words)):
                x = ids[sub.at[k] : sub.at[k] + n[k]].tolist()
                if tuple(x[: j + 2]) in after:
                    after[tuple(x[: j + 2])] += counts[k]
            assert total[at] == pytest.approx(sum(after.values()) + ends[at])
            assert j == 0 and num[at] == 0 or j > 0


def test_lm_score_is_the_networks(monkeypatch):
    """Texts are encoded once, where they are counted; a score is the network's log10 probability of the text's ids and end, and nothing else."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", "the bird and the bee", "a", "rare wordings \u00e9t\u00e9 the bird", "", "x " * 90]
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array([4, 1, None, 2, 3, 5]), "text": texts, "held_out": [True, False, False, True, False, False]})
    out = pa.Table.from_batches(lm._counts(path)([rows]))
    units = out.filter(out["docs"].is_valid()).select(lm.ENCODED).combine_chunks().to_batches()
    sub = lm.Subwords(path)
    numbers = [sub.numbers(lm.words_of(t)) for t in texts]
    ids = [sub.ids[sub.spread(x)[0]].astype(np.int64) for x in numbers]
    counts, want = Counter(), np.zeros((A.VOCAB, A.VOCAB))
    for i in (1, 2, 4, 5):
        counts.update(lm.words_of(texts[i]))
        np.add.at(want, ([A.END, *ids[i]], [*ids[i], A.END]), 1)
    told = [r for r in out.to_pylist() if r["docs"] is None]
    assert {r["word"]: r["n"] for r in told if r["word"]} == counts and {r["pair"]: r["n"] for r in told if r["word"] is None} == {a * A.VOCAB + b: want[a, b] for a, b in zip(*np.nonzero(want), strict=True)}
    log_class, log_in = A.prior(want)
    params = A.initial()
    shared = type("Shared", (), {"value": ({b"the": 2, b"x": 90}, log_class, log_in, A.pack(params), None, None, 97, 6, 4)})
    monkeypatch.setattr(lm.Subwords, "library", lambda *a: pytest.fail("encoded again"))
    got = {r["doc_id"]: r for b in lm._scored(path, shared)(units) for r in b.to_pylist()}
    model = A.Model(params, log_class, log_in)
    for i, doc in enumerate(rows.column("doc_id").to_pylist()):
        assert got[doc]["score"] == pytest.approx(model.log_probs(streamed(ids[i])).astype(float).sum() / np.log(10), abs=2e-4)
        words = lm.words_of(texts[i])
        assert got[doc]["n_tokens"] == len(words) + 1 and got[doc]["known"] == sum(w in (b"the", b"x") for w in words) + 1
        assert {t["w"]: t["n"] for t in got[doc]["tail"]} == Counter(w for w in words if w not in (b"the", b"x"))


def test_equal_texts_score_equally(spark):
    texts = ["a bird in the hand is worth two", "", "x " * 40, "a bird in the hand is worth two", "another one with words of its own", "a bird in the hand is worth two"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 3):
        got = {r.doc_id: r.score for r in lm.score(d.repartition(parts), F.lit(False), public_tokenizers.path("byte_bpe_50k.json")).collect()}
        assert got[0] == got[3] == got[5]


def test_lm_counts(spark, docs, empty):
    got = lm.score(docs, F.col("doc_id") == 4, public_tokenizers.path("byte_bpe_50k.json")).collect()
    c = Counter()
    for x in rows():
        if x[0] != 4:
            c.update((x[1] or "").encode().lower().split() + ["end"])
    n, v = sum(c.values()), len(c)
    words = {x[0]: (x[1] or "").encode().lower().split() + ["end"] for x in rows()}
    for r in got:
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words[r.doc_id])
        assert r.base_score == pytest.approx(base) and r.n_tokens == len(words[r.doc_id]) and r.train_tokens == n
        assert r.n_known == sum(c[w] > 0 for w in words[r.doc_id]) and r.score < 0
    assert lm.score(empty, F.lit(False), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_lm_network_learns_from_every_training_text(spark, docs, monkeypatch):
    path, seen = public_tokenizers.path("byte_bpe_50k.json"), []
    whole = lm.train
    monkeypatch.setattr(lm, "train", lambda learn, *more: seen.append((learn.collect(), whole(learn, *more))) or seen[-1][1])
    lm.score(docs, F.col("doc_id") == 4, path)
    given, (tokens, _) = seen[0]
    texts = [x[1] or "" for x in rows() if x[0] != 4]
    assert sum(len(r.lengths) // 8 for r in given) == len(texts)
    sub = lm.Subwords(path)
    sizes = [int(sub.spread(sub.numbers(lm.words_of(t)))[1].sum()) for t in texts]
    assert tokens == sum(n + max(1, -(-n // lm.STREAM)) for n in sizes)


def test_queries_are_named():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES} == set(range(1, 11))


def near_texts():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    out = []
    for k in range(30):
        base = rng.choice(words, 60 + 7 * k).tolist()
        for edits in (0, 0, 1, 1, 2, 3):
            t = list(base)
            for at in rng.integers(0, len(t), edits):
                t[at] = "new" + str(rng.integers(1000))
            out.append(" ".join(t))
    line = " ".join(rng.choice(words, 12))
    return out + [line + " " + " ".join(rng.choice(words, 20)) for _ in range(40)] + ["", "two words", "Two  words"]


def test_shingles_tell_texts_apart():
    rng = np.random.default_rng(9)
    parts = ["a", "B", "ab", "é", "x" * 300, " ", "\t", "\n", "\x0b", "  ", "\x1c", "0", "-"]
    texts = {"".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(3000)} | {"w " * 70_000, "w " * 3}
    seen = {}
    for t in texts:
        w = t.encode().lower().split()
        sets = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        got = shingles.shingles(t)
        assert len(got) == len(sets) and seen.setdefault(got.tobytes(), sets) == sets
    assert len(set(seen.values())) == len(seen)
    words = b"alpha beta gamma delta".split()
    assert len({int(x) for w in words for x in shingles.word_hashes(f"  {w.decode()} filler {w.decode().upper()}")[[0, 2]]}) == 4


def near_groups(texts):
    sets = [set(shingles.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and ((not a and not b) or (a | b and len(a & b) / len(a | b) >= 0.8)):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("block", [4, 256])
def test_near_copies_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    texts = near_texts()
    got = {r["hash"]: r["root"] for r in shingles.near_copies(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    mine = [got[hashlib.md5(t.encode()).hexdigest()] for t in texts]
    want = near_groups(texts)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want)) < len(texts) - 30


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline as C

    texts = near_texts()
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in C.drop_near_copies(spark, d, "").collect()) == sorted(set(near_groups(texts)))


def test_pipeline_tells_rows_with_one_id_apart(spark):
    import corpus_pipeline as C

    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey"
    d = spark.createDataFrame([(1, a), (1, b), (2, b), (None, c), (None, c), (None, a), (3, a)], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in C.drop_near_copies(spark, d, "").collect())
    assert got == Counter([(1, a), (1, b), (None, c)])


def test_pipeline_mixes_rows_by_shard(spark, tmp_path):
    import corpus_pipeline as C

    d = spark.createDataFrame([(None if i % 9 == 0 else i // 2, f"{i} " + "w " * (i % 40), "en", f"s{i % 3}", 0) for i in range(600)], "doc_id long, text string, lang string, source string, n_chars long")
    C.mix_sources(spark, d, "").write.parquet(str(tmp_path / "mixed"))
    out = spark.read.parquet(str(tmp_path / "mixed")).withColumn("_at", F.input_file_name()).withColumn("_no", F.monotonically_increasing_id())
    got = [(r.text, r.source) for r in sorted(out.collect(), key=lambda r: (r["_at"].rsplit("/", 1)[1], r["_no"]))]
    rows = d.withColumn("_row", F.col("text"))
    want = mixing.mix(rows, carry=("_row",)).collect()
    assert Counter(t for t, _ in got) == Counter({r["_row"]: r.copies for r in want if r.copies})
    goal, taken = {r.source: r.target for r in want}, Counter()
    for text, source in got:
        taken[source] += len(text.split())
    assert all(abs(taken[k] - v) <= 45 for k, v in goal.items())
    shards, at = {r["_row"]: r.shards for r in want}, 0
    for text, _ in got:
        assert any(x >= at for x in shards[text])
        at = min(x for x in shards[text] if x >= at)
    assert at == mixing.SHARDS - 1
    assert sum(a == b for a, b in zip(got, got[1:], strict=False)) < 10


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{D}/documents.parquet")
    for name, f in C.STAGES[:-1]:
        out = f(spark, docs, D)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name in ("toxicity", "simhash"):
            assert 0 < docs.count() <= before.count() and docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "simhash":
            assert docs.select("doc_id").distinct().count() == docs.count()
    assert C.STAGES[-1][1](spark, docs, D).agg(F.sum("length")).first()[0] > 0
