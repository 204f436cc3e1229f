"""Each operator on a small table of hard cases, against a plain version."""

import hashlib
import importlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import bwt, decontaminate, language_id, lm_score, ngram_join, simple8b, suffix_dedup, token_file, warc
from tickloom.llm.exact_dedup import exact_dedup
from tickloom.llm.mix_sources import mix_rows, mix_sources, targets, word_count
from tickloom.llm.shard import fill, shard

exact_dedup_module = importlib.import_module("tickloom.llm.exact_dedup")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, size long, id string, k string, _slot string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def some_text(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(r.integers(0, 40)) for i in r.integers(0, len(WORDS), n))


def hard_docs():
    a, b = some_text(1, 120), some_text(2, 90)
    words = a.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    rows = [
        (0, a), (1, None), (2, ""), (3, a.upper()), (4, b), (5, near), (6, "two words"), (7, "Two  words\n"), (8, "\x1c nbsp"), (9, b + " " + a), (10, "1234 !!"),
        (11, " ".join([b] * 40)), (12, "é" * 300), (13, "é" * 299 + "x"), (14, some_text(3, 3000)), (15, "\t\n "), (16, a), (17, "  " + a + "  "), (18, "ſtraße İstanbul ’s don't 12,5"),
    ]
    return [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", 0, "x", 1, "x", "x", "x") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hard_docs(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def twice(spark):
    """Repeated rows, repeated ids with other texts, and null ids."""
    rows = hard_docs()[:6]
    more = [(0, "other text of the first id", *rows[0][2:]), (None, rows[0][1], *rows[0][2:]), (None, None, *rows[0][2:])]
    return spark.createDataFrame(rows + rows[:3] + more, SCHEMA)


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def thue_morse(n):
    """Two words of n bytes that any polynomial hash modulo 2**64 confuses from 1,024 bytes on."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


TWINS = [w for n in (512, 1024, 4096) for w in thue_morse(n)]


def test_words_that_polynomials_confuse(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    data = [(i, w) for i, w in enumerate(TWINS)] + [(6, TWINS[2] + " x y z w"), (7, TWINS[3] + " x y z w")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert all(r.component_id == r.doc_id and r.n_shingles == 1 for r in ngram_join.link_classes(df, "doc_id", "text").collect())
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    crc = {i: zlib.crc32(np.array([*t.encode(w, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, w in data}
    assert {r.doc_id: r.ids_crc32 for r in token_file.encode_documents(df, "doc_id", "text", path, 1).collect()} == crc
    trained = Counter(w for i, x in data for w in x.split() if zlib.crc32(str(i).encode()) % 10)
    known = {i: sum(trained[w] > 0 for w in x.split()) + 1 for i, x in data}
    assert {r.doc_id: r.n_known for r in lm_score.score_documents(df, "doc_id", "text").collect()} == known
    want = repeats(data)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, "doc_id", "text").collect()} == want


# ---- exact dedup -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("poor", [False, True])
@pytest.mark.parametrize("few", [500_000, 1])
def test_exact_dedup(docs, keep, poor, few, monkeypatch):
    monkeypatch.setattr(exact_dedup_module, "BROADCAST_GROUPS", few)
    monkeypatch.setattr(exact_dedup_module, "LARGE", 2)
    weak = (lambda t: F.encode((F.length(t) % 3).cast("string"), "utf-8")) if poor else None
    got = {r.doc_id: r for r in exact_dedup(docs, "doc_id", "text", keep, weak).collect()}
    by = {}
    for i, t, *_ in hard_docs():
        by.setdefault(fold(t), []).append(i)
    for i, t, *_ in hard_docs():
        g = by[fold(t)]
        want = (min if keep == "min" else max)(g)
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (want, len(g), i == want, hashlib.sha256(fold(t).encode()).hexdigest())


def test_exact_dedup_edges(none, twice):
    assert exact_dedup(none, "doc_id", "text").count() == 0
    rows = exact_dedup(twice, "doc_id", "text", "max").collect()
    assert len(rows) == twice.count()
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in rows}


# ---- token file ------------------------------------------------------------------------------------------------------


def test_simple8b_round_trip():
    r = np.random.default_rng(5)
    for v in (r.integers(0, 50000, 40000), r.integers(0, 2, 999), np.zeros(0), r.integers(0, 1 << 62, 500) * 3, np.concatenate([np.full(5000, 7), r.integers(1 << 61, 1 << 62, 9), np.zeros(70)])):
        v = np.asarray(v).astype(np.uint64)
        block = simple8b.encode(v)
        assert (simple8b.decode(block) == v).all()
        if len(v) > 20000:
            assert (simple8b.decode(block, 1) == v[simple8b.CHUNK : 2 * simple8b.CHUNK]).all()
    with pytest.raises(ValueError):
        simple8b.decode(b"\0" * 64)


def test_token_file(docs, none, twice):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_file.encode_documents(docs, "doc_id", "text", path, 1).collect()}
    at = 0
    for i, text, *_ in sorted(hard_docs(), key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        at += len(ids)
    assert token_file.encode_documents(none, "doc_id", "text", path, 1).count() == 0
    rows = token_file.encode_documents(twice, "doc_id", "text", path, 1).collect()
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert len(rows) == twice.count() and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_word_encoder_forgets_and_splits_like_the_library():
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    definition = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    plain, mine = Tokenizer.from_str(definition), token_file.WordEncoder(definition)
    mine.MOST = 40

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aA bé.,'s<|>\n\t́ İ1٣ſ"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
    def run(texts):
        parts = [x.encode() for x in [*texts, "<|endoftext|> <|ENDOFTEXT|>x"]]
        by = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        ids, at = mine.encode(np.frombuffer(b"".join(parts), np.uint8), by)
        for k, p in enumerate(parts):
            assert ids[at[k] : at[k + 1]].tolist() == plain.encode(p.decode(), add_special_tokens=False).ids

    run()


def test_word_encoder_compares_bytes(monkeypatch):
    """With a hash that confuses words, in a block and with those it remembers, ids are still the library's."""
    import public_tokenizers
    from tokenizers import Tokenizer

    definition = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    plain, mine = Tokenizer.from_str(definition), token_file.WordEncoder(definition)
    mine.hash = lambda lane, first, k, size: (size % 3).astype(np.uint64)
    for texts in (["a", "bb ccc", "a bb"], ["a", "dd eee"], ["bb ccc a, bb."], ["zz", "", "ccc"]):
        parts = [x.encode() for x in texts]
        ids, at = mine.encode(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
        for k, p in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == plain.encode(p, add_special_tokens=False).ids


def test_word_encoder_composes_before_it_folds():
    import public_tokenizers
    from tokenizers import Tokenizer

    definition = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    plain, mine = Tokenizer.from_str(definition), token_file.WordEncoder(definition)
    for words in (["J\u030ca", "H\u0331amas.", "T\u0308X", "W\u030a,", "Y\u030aab AB"], ["H\u0331amas", "Ab<|endoftext|>Cd", "J\u030ca <|"]):
        parts = [x.encode() for x in words]
        ids, at = mine.encode(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
        for k, p in enumerate(parts):
            assert ids[at[k] : at[k + 1]].tolist() == plain.encode(p.decode(), add_special_tokens=False).ids, words[k]


# ---- mixing ----------------------------------------------------------------------------------------------------------


def fill_by_rounds(sizes, weights, share, most):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        wide = sum(w[s] for s in names if s not in full)
        got = {s: most * sizes[s] if s in full else rest * w[s] / wide for s in names}
        over = {s for s in names if s not in full and got[s] > most * sizes[s]}
        if not over:
            return got
        full |= over


def test_targets_by_rounds(spark):
    for sizes in ({"a": 10, "b": 500, "c": 20, None: 3}, {"a": 7}, {"b": 0, "a": 5, "c": 5}, {f"s{k:02d}": (k * 37) % 101 for k in range(20)}):
        rows = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 1.5, 2).collect()
        want = fill_by_rounds(sizes, (5, 2, 1), 1.5, 2)
        assert all(abs(r.target - want[r.source]) < 1e-6 for r in rows)


def test_mix(spark, docs, none, twice):
    r = np.random.default_rng(2)
    rows = [(int(i), f"s{min(int(r.exponential(1.2)), 4)}", int(r.integers(1, 50))) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mix_sources(df, "doc_id", "source", F.col("n")).collect()
    by = {}
    source = {i: s for i, s, _ in rows}
    for x in got:
        assert 0 <= x.taken <= 2 * x.size and x.taken % x.size == 0
        by.setdefault(source[x.doc_id], [0, x.target])[0] += x.taken
    assert all(abs(a - b) <= 25 for a, b in by.values())
    assert sorted((x.doc_id, x.taken) for x in got) == sorted((x.doc_id, x.taken) for x in mix_sources(df.repartition(5), "doc_id", "source", F.col("n")).collect())
    sizes = {x.doc_id: x.size for x in mix_sources(docs, "doc_id", "source", word_count(F.col("text"))).collect()}
    assert sizes == {i: len(split(t)) for i, t, *_ in hard_docs()}
    assert mix_sources(none, "doc_id", "source", word_count(F.col("text"))).count() == 0
    assert mix_sources(twice, "doc_id", "source", word_count(F.col("text"))).count() == twice.count()


# ---- sharding --------------------------------------------------------------------------------------------------------


def test_fill_claims_in_turn():
    owner = fill([f"n{k}" for k in range(5)], 101)
    assert max(Counter(owner).values()) - min(Counter(owner).values()) <= 1
    fewer = fill([f"n{k}" for k in range(4)], 101)
    assert sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 4) < 40
    for names, slots in (([], 7), (["a", "a"], 7), (["a"], 9), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            fill(names, slots)


def test_shard(spark, docs, none, twice):
    owner = fill([f"shard-{k}" for k in range(8)], 251)
    for r in shard(docs, F.col("doc_id"), 8, 251).collect():
        assert r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 251 and r.shard == owner[r.slot] and r.k == "x"
    assert shard(none, F.col("doc_id")).count() == 0 and shard(twice, F.col("doc_id")).count() == twice.count()
    hot = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), "id")
    spread = shard(hot, F.col("key"), 8, 251, spread_by=F.col("id"))
    assert spread.count() == 5000 and spread.columns == ["key", "id", "slot", "shard"]
    assert spread.filter("key = 'hot'").groupBy("shard").count().agg(F.max("count")).first()[0] < 1667


# ---- suffix dedup ----------------------------------------------------------------------------------------------------


def repeats(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for a in range(len(b) - 99):
            if b[a : a + 100] in seen:
                gone[a] += 1
                gone[a + 100] -= 1
            else:
                seen.add(b[a : a + 100])
        m = np.cumsum(gone)[: len(b)] > 0
        out[i] = (len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest())
    return out


def test_window_classes():
    r = np.random.default_rng(3)
    for n, letters in ((400, 2), (2000, 3), (1200, 1), (40, 200)):
        t = r.integers(97, 97 + letters, n).astype(np.uint8)
        if n > 300:
            t[n - 130 :] = t[:130]
        for w in (9, 30, 100):
            c, by, back, b = bwt.window_classes(t, w), {}, {}, t.tobytes()
            for i in range(n - w + 1):
                assert by.setdefault(b[i : i + w], c[i]) == c[i] and back.setdefault(c[i], b[i : i + w]) == b[i : i + w]


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup(docs, none, twice, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "TEXT_BYTES", 3000)
    want = repeats(sorted((i, t) for i, t, *_ in hard_docs()))
    for r in suffix_dedup.remove_repeats(docs, "doc_id", "text").collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert suffix_dedup.remove_repeats(none, "doc_id", "text").count() == 0
    assert suffix_dedup.remove_repeats(twice, "doc_id", "text").count() == twice.count()


def test_suffix_dedup_compares_bytes(spark, monkeypatch):
    """Codes under which different bytes look alike make false claims; they are found, and other codes are taken."""
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    vowels = suffix_dedup.CODES[0].copy()
    vowels[[ord(c) for c in "aeiou0123456789"]] = ord("x")
    base = some_text(40, 60)
    rows = [(1, base), (2, base.translate(str.maketrans("aeiou", "eioua"))), (3, base + " and more " + some_text(41, 40)), (4, some_text(41, 40) + base), (5, base.replace("0", "1"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = repeats(rows)
    for codes in ([vowels, *suffix_dedup.CODES],):
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, "doc_id", "text", codes).collect()} == want
    with pytest.raises(RuntimeError):
        suffix_dedup.remove_repeats(df, "doc_id", "text", [vowels])


def test_seen_runs_are_earlier_and_hot_ones_are_found():
    r = np.random.default_rng(8)
    seen, met, found = suffix_dedup.Seen(6), set(), 0
    for _ in range(200):
        run = r.integers(0, 90, 50).astype(np.uint64)
        place = r.permutation(400)[:50]
        anchor, key, a = run >> np.uint64(2), place // 20, (place % 20).astype(np.int32)
        got, source, b = seen.repeated(anchor, run, key, a)
        place_of = {(x, k, p) for x, k, p in met} | set(zip(run.tolist(), key.tolist(), a.tolist(), strict=True))
        assert all((x, k, p) in place_of for x, k, p, g in zip(run.tolist(), source.tolist(), b.tolist(), got.tolist(), strict=True) if g)
        met |= set(zip(run.tolist(), key.tolist(), a.tolist(), strict=True))
        least = {x: min(m[1:] for m in met if m[0] == x) for x in set(run.tolist())}
        assert all((k, p) > least[x] for x, k, p, g in zip(run.tolist(), key.tolist(), a.tolist(), got.tolist(), strict=True) if g)
        found += got.sum()
    assert found > 5000


# ---- WARC ------------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    big = "<p>" + "é x" * 60
    pages = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (0, None, "short"), (5, "u", "short"), (3, "http://c", None), (4, "http://d", "in the text WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9), (7, "x", "WARC/1."), (2, "http://b", big), (None, "n", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(2)
    got = warc.round_trip(df, "page_id", "url", "html", str(tmp_path / "w")).collect()
    assert len(got) == len(pages)
    for r in got:
        body = next((h or "").encode() for p, _, h in pages if p == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 1) if body == big.encode() and r.page_id != 1 else ("response", None))
    whole = warc.assemble(warc.read(spark, str(tmp_path / "w"))).filter("capture.record_type = 'response'").first()
    assert len(whole.requests) >= 1 and len(whole.metadata) >= 1 and whole.requests[0].target_uri == whole.capture.target_uri
    assert warc.round_trip(df.limit(0), "page_id", "url", "html", str(tmp_path / "e")).count() == 0


# ---- n-gram join -----------------------------------------------------------------------------------------------------


def shingles(t, k=5):
    w = split(fold(t))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def classes(rows):
    s, low = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i in s:
        for j in s:
            if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                low[b] = a
    return {i: (len(s[i]), find(i)) for i in s}


def test_ngram_join(spark, docs, none, twice):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_classes(docs, "doc_id", "text").collect()}
    assert got == classes([(i, t) for i, t, *_ in hard_docs()])
    assert ngram_join.link_classes(none, "doc_id", "text").count() == 0
    rows = ngram_join.link_classes(twice, "doc_id", "text").collect()
    assert len(rows) == twice.count() and all(r.component_id is None for r in rows if r.doc_id is None)


def test_ngram_join_loses_no_link_near_the_threshold(spark):
    r = np.random.default_rng(9)
    rows = []
    for size in (5, 6, 9, 14, 30, 45, 80, 200, 400):
        for k in range(4):
            base = [f"w{x}" for x in r.integers(0, 10**6, size)]
            rows.append(base)
            for cut in (1, max(1, size // 45), max(1, size // 22), size // 10):
                near = list(base)
                for i in r.integers(0, size, cut):
                    near[i] = f"v{r.integers(0, 10**6)}"
                rows += [near, base[: size - cut], base + near[:cut]]
    data = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.link_classes(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == classes(data)


def test_ngram_join_groups_of_near_copies(spark, monkeypatch):
    """Many documents around one text, close to each other or just too far, in blocks of a few members."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    r = np.random.default_rng(4)
    base = [f"w{x}" for x in r.integers(0, 10**6, 120)]
    rows = []
    for k in range(120):
        near = list(base)
        for i in r.choice(120, 1 + k % 7, replace=False):
            near[i] = f"v{k}_{i}"
        rows.append(near)
    for k in range(40):  # half the text in common: never similar
        rows.append(base[:60] + [f"u{k}_{i}" for i in range(60)])
    data = [(int(i), " ".join(rows[k])) for k, i in enumerate(r.permutation(len(rows)))]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.link_classes(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == classes(data)


def test_sketches_bound_the_difference():
    r = np.random.default_rng(12)
    for n, m in ((30, 30), (300, 340), (900, 1100)):
        a = [f"w{x}" for x in r.integers(0, 10**6, m)]
        b = list(a[:n])
        for i in r.integers(0, n, n // 8):
            b[i] = "x"
        texts = [" ".join(a).encode(), " ".join(b).encode()]
        s = ngram_join.Sets(np.frombuffer(b"".join(texts), np.uint8), np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])]))
        x, y = (np.frombuffer(k, np.uint64)[None] for k in s.sketches())
        size = min(x.shape[1], y.shape[1])
        p, q = (shingles(t.decode()) for t in texts)
        assert int(np.bitwise_count(ngram_join.fold(x, size) ^ ngram_join.fold(y, size)).sum()) <= len(p ^ q) and [len(p), len(q)] == s.size.tolist()


def test_exact_sets_number_by_words():
    texts = [b"A b c d e f", b"a B c d e f g", b"a b", b"A  b\n", b"", b"a b c d e", b"b a"]
    sets = ngram_join.exact_sets(texts)
    want = [shingles(t.decode()) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j]) and len(sets[i]) == len(want[i])


# ---- language ID -----------------------------------------------------------------------------------------------------


def test_language_id(spark, docs, none, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.train(table.filter(~held), "doc_id", "text", "lang")
    out = language_id.classify(table.filter(held), model, "text").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95 and all(0 <= r.score <= 1 for r in out)
    hard = {r.doc_id: r for r in language_id.classify(docs, model, "text").collect()}
    assert {i for i, r in hard.items() if r.lang_pred == "und"} == {1, 2, 10, 15} and hard[1].score == 0 and hard[0].k == "x"
    assert language_id.classify(none, model, "text").count() == 0
    empty = language_id.train(none, "doc_id", "text", "lang")
    assert {r.lang_pred for r in language_id.classify(docs, empty, "text").collect()} == {"und"}


def grams(text):
    """Hashed byte n-grams of a text, one at a time."""
    out, data = set(), [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    for k in language_id.ORDERS:
        for i in range(len(data) - k + 1):
            code = 0
            for b in data[i : i + k]:
                code = (code * 0x01000193 + b) % 2**32
            out.add((((code ^ (code >> 15)) * 0x2C1B3C6D + k) % 2**32) >> 18)
    return out


def test_language_id_by_plain_kernel_regression(spark):
    """The kernel by sets, the regression in its dual form over landmark features, for a few texts."""
    words = {"aa": "los ardo cion rado que esta", "bb": "the tion wher and hath ouse", "cc": "und ich sche heit auf zuer"}
    r = np.random.default_rng(6)
    rows = [(k, " ".join(r.choice(words[x].split(), 12)) + (" 7" if k % 2 else " Mix"), x) for k, x in enumerate(sorted(words) * 9)]
    rows += [rows[0], rows[0], (None, "the and hath", "bb"), (None, "the and hath", "bb"), (90, None, "aa"), (91, "12 34", "aa"), (92, "und ich", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    chosen = language_id.sample(df, "doc_id", "text", "lang")
    assert len(chosen) == 28  # equal rows once; no null, letterless or unlabelled ones
    model = language_id.train(df, "doc_id", "text", "lang")
    texts = {frozenset(grams(t)): x for _, t, x in rows if t and x and any(c.isalpha() for c in t)}
    sets = []
    for name, _, bits in chosen:
        got = frozenset(np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))).tolist())
        assert texts[got] == name
        sets.append(got)
    kernel = lambda a, b: len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))
    names = sorted(words)
    y = np.array([names.index(n) for n, *_ in chosen])
    k = np.array([[kernel(a, b) for b in sets] for a in sets])  # all are landmarks
    values, vectors = np.linalg.eigh(k)
    root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    phi = np.hstack([k @ root, np.ones((len(k), 1))])
    balance = np.diag(1 / np.bincount(y)[y])
    ridge = language_id.RIDGE / phi.shape[1]
    dual = np.linalg.solve(phi @ phi.T @ balance + ridge * np.eye(len(k)), np.where(y[:, None] == np.arange(3), 1.0, -1.0))
    w = phi.T @ balance @ dual
    for x in language_id.classify(df, model, "text").collect():
        if x.text is None or not any(c.isalpha() for c in x.text):
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        s = np.hstack([np.array([kernel(grams(x.text), b) for b in sets]) @ root, [1.0]]) @ w
        e = np.exp(4 * (s - s.max()))
        assert x.lang_pred == names[int(s.argmax())] and abs(x.score - e.max() / e.sum()) < 1e-3


def test_language_id_keeps_labels_of_long_and_repeated_texts(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PER_LABEL", 4)
    rows = [(7, "die und der ", "de")] * 300 + [(k, "the and of " + "x" * k, "en") for k in range(9)] + [(500, "le les une " * 200_000, "fr")]
    got = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 4)
    assert Counter(x for x, *_ in got) == {"de": 1, "en": 4, "fr": 1}


# ---- LM scoring ------------------------------------------------------------------------------------------------------


def test_lm_score(spark, docs, none, twice, monkeypatch, sf):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 50_000)
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = [(r.doc_id, [*split(fold(r.text)), "\0end"]) for r in table.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm_score.score_documents(table, "doc_id", "text").collect()}
    for i, t in rows:
        r, base = got[i], sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    out = [got[i] for i, _ in rows if held[i]]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm_score.score_documents(none, "doc_id", "text").count() == 0
    assert lm_score.score_documents(twice, "doc_id", "text").count() == twice.count()


def test_lm_score_by_plain_interpolation(spark, docs):
    """Counts, histogram, weights and scores once more with dictionaries."""
    table = docs.select("doc_id", "text").union(docs.select((F.col("doc_id") + 100).alias("doc_id"), F.concat_ws(" ", F.lit("alpha1 beta2"), "text").alias("text")))
    rows = [(r.doc_id, [*split(fold(r.text)), "\0end"], zlib.crc32(str(r.doc_id).encode()) % 10) for r in table.collect()]

    def tallies(parts):
        one, two = Counter(), Counter()
        for _, t, p in rows:
            if p in parts:
                one.update(t)
                two.update(zip(["\0end", *t[:-1]], t, strict=True))  # a text begins where one ends
        return one, two

    kept, kept2 = tallies(set(range(2, 10)))
    n, v = sum(kept.values()), len(kept)
    hist = Counter()
    for _, t, p in rows:
        if p == 1:
            for h, w in zip(["\0end", *t[:-1]], t, strict=True):
                bins = [int(np.rint((np.log2(a / max(b, 1) * (v + 1)) + 8) / lm_score.GRID)) + 1 if a else 0 for a, b in ((kept2[h, w], kept[h]), (kept[w], n))]
                hist[(min(int(np.log2(kept[h] + 1)), lm_score.LEVELS - 1), *bins)] += 1
    weights = lm_score.learn([(*k, c) for k, c in hist.items()])
    every, every2 = tallies(set(range(1, 10)))
    n, v = sum(every.values()), len(every)
    got = {r.doc_id: r.score for r in lm_score.score_documents(table, "doc_id", "text").collect()}

    def probability(h, w):
        a2, a1, a0 = weights[min(int(np.log2(every[h] + 1)), lm_score.LEVELS - 1)]
        a2 = a2 if every[h] else 0.0
        return (a2 * (every2[h, w] / every[h] if every[h] else 0) + a1 * every[w] / n + a0 / (v + 1)) / (a2 + a1 + a0)

    for i, t, _ in rows:
        want = sum(np.log10(probability(h, w)) for h, w in zip(["\0end", *t[:-1]], t, strict=True))
        assert abs(got[i] - want) < 1e-6 * abs(want), i
    for h in ("alpha1", "\0end", "never seen"):  # over all words and one unknown they sum to one
        assert abs(sum(probability(h, w) for w in every) + probability(h, "\0unknown") - 1) < 1e-9


def test_lm_sums_do_not_wrap():
    for most, want in ((2**32 - 1, [2**32 + 4, 3]), (7, [12, 3])):
        got = lm_score.sums(np.array([0, 1, 0]), np.array([most, 3, 5], np.uint32), 2)
        assert lm_score.unsized_planes(lm_score.sized_planes(got)).tolist() == want


def test_learned_weights_follow_the_evidence():
    bins = lambda p: int(np.rint((np.log2(p) + 8) / lm_score.GRID)) + 1
    w = lm_score.learn([(5, bins(500), bins(2), 900), (7, 0, bins(4), 900), (9, 0, 0, 900)])
    assert w[5].argmax() == 0 and w[7].argmax() == 1 and w[9].argmax() == 2 and np.allclose(w.sum(1), 1)


# ---- decontamination -------------------------------------------------------------------------------------------------


def contained(docs, items):
    merged = {}
    for i, t in docs:
        merged.setdefault(i, set()).update(set(shingles_lower(t)))
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(shingles_lower(t))
    return {(d, i): len(s & x) for d, x in merged.items() for i, s in wanted.items() if s and 100 * len(s & x) >= 80 * len(s)}


def shingles_lower(t, k=5):
    w = split((t or "").lower())
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_decontaminate(spark, docs, none):
    a, c = some_text(1, 120).split(), some_text(3, 3000).split()
    items = [(1, " ".join(a[10:40])), (2, " ".join(c[2900:2920])), (3, None), (4, ""), (5, "two words"), (6, some_text(77, 30)), (7, " ".join(c[100:112] + ["other"] + c[113:160])), (8, " ".join(a[5:12])), (2, " ".join(c[2900:2920]))]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    got = {(r.doc_id, r.item_id): r.shared for r in decontaminate.find_contained(docs, table).collect()}
    assert got == contained([(i, t) for i, t, *_ in hard_docs()], items) and (14, 2) in got and (6, 5) in got
    assert decontaminate.find_contained(none, table).count() == 0 and decontaminate.find_contained(docs, table.limit(0)).count() == 0


def test_decontaminate_with_repeated_and_null_ids(spark):
    a = some_text(5, 60)
    words = a.split()
    docs_ = [(1, " ".join(words[:30])), (1, " ".join(words[28:])), (None, a), (None, "nothing here at all today"), (2, None), (3, a), (3, a)]
    items = [(1, a), (None, " ".join(words[5:25])), (1, a)]
    got = {(r.doc_id, r.item_id): (r.item_shingles, r.shared) for r in decontaminate.find_contained(spark.createDataFrame(docs_, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = contained(docs_, items)
    assert {k: v[1] for k, v in got.items()} == want and (None, 1) in want and (1, 1) in want and (1, None) in want


def test_decontaminate_large_items_at_the_edge(spark):
    """Items of hundreds of shingles, whose sketches have more hashes than a mask has bits, found at 80 % and not below."""
    r = np.random.default_rng(31)
    docs_, items = [], []
    for i, n in enumerate((70, 200, 400, 900)):
        words = [f"w{x}" for x in r.integers(0, 10**6, n)]
        items.append((i, " ".join(words)))
        lost = (n - 4) // 5
        for j, cut in enumerate((lost, lost + 1, lost + 2)):  # a run cut off the end costs one shingle a word
            docs_.append((10 * i + j, "before it " + " ".join(words[: n - cut])))
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_contained(spark.createDataFrame(docs_, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == set(contained(docs_, items)) and {d % 10 for d, _ in got} == {0}


def test_clashing_names_come_out_unchanged(spark):
    """Columns named like an operator's own, in either case, keep their values."""
    names = ["_slot", "_SHARD", "_key", "_n", "_parts", "_hot", "_source", "_copies", "_cut", "_size", "_h", "_group", "_target", "_source_size", "_got", "_known", "_p", "_l", "h", "d", "t", "k", "id", "sig"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, some_text(i, 30), "en", f"s{i % 3}", *[f"{n}-{i}" for n in names]) for i in range(12)]
    df = spark.createDataFrame(rows, schema)
    model = language_id.train(df, "doc_id", "text", "lang")
    outs = {
        "shard": shard(df, F.col("doc_id"), 8, 251), "spread": shard(df, F.col("lang"), 8, 251, spread_by=F.col("doc_id")),
        "mix": mix_rows(df, "doc_id", "source", word_count(F.col("text"))), "classify": language_id.classify(df, model, "text"),
    }
    for what, out in outs.items():
        assert out.columns[: len(df.columns)] == df.columns, what
        assert sorted(tuple(r)[: len(df.columns)] for r in out.collect()) == sorted(rows), what
    taken = shard(df.withColumnRenamed("k", "SLOT"), F.col("doc_id"), 8, 251)
    assert [c.lower() for c in taken.columns].count("slot") == 1 and {r.slot for r in taken.collect()} <= set(range(251))


# ---- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, sf):
    import corpus_pipeline

    frame = docs.select("doc_id", "text", "lang", "source", "n_chars")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf)
        seen.append((name, {r.doc_id for r in frame.select("doc_id").collect()}))
        if name != "shard":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    by = dict(seen)
    assert by["language_id"] == {i for i, *_ in hard_docs()} - {1, 2, 10, 15}
    assert not by["ngram_join"] & {3, 16, 17, 7} and 0 in by["ngram_join"]
    assert by["mix_sources"] <= by["decontaminate"] and "shard" in frame.columns


def test_pipeline_rows_stand_for_themselves(spark, sf):
    """Repeated and null ids, and columns named like the stages' own: no row goes because of another."""
    import corpus_pipeline

    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("octet_length(text) > 200").first().text
    base = some_text(21, 200)
    near = " ".join(["changed", *base.split()[1:]])
    names = ["size", "target", "taken", "copies", "source_size", "_lang", "_score", "_copy", "_r", "_id", "row_number", "_slot", "text_"]
    texts = [(None, base), (None, some_text(22, 90)), (None, some_text(23, 50) + " " + item), (5, near), (5, some_text(24, 80)), (6, some_text(25, 70)), (6, item), (7, None), (8, ""), (9, some_text(26, 100) + "\n" + some_text(26, 100))]
    rows = [(i, t, "en", "s", 0, *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = frame.columns
        frame = stage(spark, frame, sf)
        if name != "shard":
            assert frame.columns == columns
        got = frame.collect()
        assert {(r.doc_id, r.text, r["size"], r["row_number"], r["_slot"]) for r in got} <= {(i, t, f"size{k}", f"row_number{k}", f"_slot{k}") for k, (i, t) in enumerate(texts)}
        kept[name] = sorted({int(r["size"][4:]) for r in got})
    assert kept["language_id"] == [0, 1, 2, 3, 4, 5, 6, 9]
    assert kept["ngram_join"] == [1, 2, 3, 4, 5, 6, 9]  # of the near pair the row with an id stays
    assert kept["decontaminate"] == [1, 3, 4, 5, 9]


def test_pipeline_against_sql_and_plain_classification(spark, sf, tmp_path):
    """The first stage against the classifier's own scores, the others against SQL over the rows that it kept."""
    import duckdb

    import compare
    import corpus_pipeline

    table = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, table, sf)
    model = language_id.train(table, "doc_id", "text", "lang")
    score = {r.doc_id: (r.lang_pred, r.score) for r in language_id.classify(table, model, "text").collect()}
    want = {i for i, (lang, p) in score.items() if lang != "und" and p >= corpus_pipeline.LEAST_SCORE}
    assert {r.doc_id for r in first.collect()} == want and len(want) > 0.9 * table.count()
    first.write.parquet(str(tmp_path / "p1.parquet"))
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    compare.tables(con, sf)
    con.sql(f"CREATE VIEW p1 AS SELECT * FROM read_parquet('{tmp_path}/p1.parquet/*.parquet')")
    frame = first
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:]):
        stage(spark, frame, sf).write.parquet(str(tmp_path / f"s{k}"))
        frame = spark.read.parquet(str(tmp_path / f"s{k}"))
    a, b = compare.canon(frame.toPandas()), compare.canon(con.sql(corpus_pipeline.REST_SQL).df())
    assert list(a.columns) == list(b.columns) and a.equals(b)


def test_language_stage_drops_what_it_cannot_tell(spark, sf):
    import corpus_pipeline

    rows = [(k, "the and of that with " * 3 + f"{k}", "en") for k in range(20)] + [(100 + k, "der und die nicht auf " * 3 + f"{k}", "de") for k in range(20)]
    rows += [(900, "zzz qqq", None), (901, "the and of with", None), (902, "die und der auf", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(frame, "doc_id", "text", "lang")
    low = {r.doc_id for r in language_id.classify(frame, model, "text").collect() if r.score < corpus_pipeline.LEAST_SCORE}
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, frame, sf).collect()}
    assert kept == {r[0] for r in rows} - low and {901, 902} <= kept


def test_language_stage_keeps_documents_when_nothing_is_labelled(spark, docs, sf):
    import corpus_pipeline

    bare = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    kept = corpus_pipeline.identify_language(spark, bare, sf)
    assert kept.columns == bare.columns and {r.doc_id for r in kept.collect()} == {i for i, *_ in hard_docs()} - {1, 2, 10, 15}


def test_empty_pipeline(spark, sf):
    import corpus_pipeline

    frame = spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string, lang string, source string, n_chars long"))
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf)
    assert frame.count() == 0


# ---- components ------------------------------------------------------------------------------------------------------


def test_components(spark):
    from tickloom.llm import components
    from tickloom.llm.common import Scratch

    r = np.random.default_rng(2)
    edges = [(0, int(k)) for k in range(1, 60)] + [(100 + k, 101 + k) for k in range(25)] + [(int(a), int(b)) for a, b in r.integers(200, 260, (40, 2))] + [(7, 7)]
    low = {x: x for e in edges for x in e}

    def find(x):
        return x if low[x] == x else find(low[x])

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        low[q] = p
    out = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "comp"), "c")
    got = {x.node: x.component for x in out.collect()}
    assert got == {x: find(x) for x in low if any(x in e and e[0] != e[1] for e in edges)}
