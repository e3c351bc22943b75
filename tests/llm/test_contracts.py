"""The operators of the training-data pipeline against brute force, with nulls, empty texts, ties and repeats."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import common, decontaminate, languages, licenses, packing, pii, quality, similarity, substrings, suffix_array, tokens, toxicity

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
EXTRA = [None, "", " \n\t", "a", "A b", "a B", "x" * 200, "ab " * 60, "ab " * 60, "é ü ñ " * 20, "1.2.3.999 1.2.3.4.5 +1 (614) 555-8001 4012-8888-8888-1881 a@b.c_x@y.z", "For For For For " * 9, "a <|endoftext|> b"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, block string"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with edge cases, a column that clashes with results, and a very long text."""
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    rows += [(1000 + i, t, "en", "src0") for i, t in enumerate(EXTRA)]
    rows.append((2000, " ".join(t for _, t, *_ in rows[:60]), "en", None))
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", None, "y") for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.collect())


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def bench(spark):
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    return b.unionByName(spark.createDataFrame([(900, None), (901, "..."), (902, "for for for"), (903, "FOR, for! for")], b.schema))


@pytest.fixture(scope="module")
def encoded(rows):
    t = Tokenizer.from_file(tokens.default_tokenizer())
    return {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(150):
        t = bytes(rng.randrange(rng.choice([1, 2, 4, 256])) for _ in range(rng.randrange(150)))
        a = np.frombuffer(t, np.uint8)
        words = suffix_array.words_at(a)
        order = suffix_array.suffix_order(a, words, 50)
        keys = [t[i : i + 50].ljust(50, b"\0") for i in order]
        assert sorted(order.tolist()) == list(range(len(t))) and keys == sorted(keys)
        same = suffix_array.same_prefix(order, words, 50)
        assert [bool(x) for x in same[1:]] == [a == b for a, b in itertools.pairwise(keys)]


@pytest.mark.parametrize("block_bytes", [1 << 24, 60_000])
def test_substrings(docs, rows, block_bytes):
    first = {}
    for i, x in rows:
        b = x.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    got = {r.doc_id: r for r in substrings.deduplicated(docs, block_bytes=block_bytes, with_text=True).collect()}
    assert len(got) == len(rows)
    for i, x in rows:
        b = x.encode()
        m = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                m[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, hit in zip(b, m, strict=True) if not hit)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == (len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest(), kept)


def test_substrings_many_copies(spark):
    """Copies beyond the limit are folded before; a missing id is left alone."""
    text = "the same text of more than fifty bytes that many documents hold "
    df = spark.createDataFrame([(i, text) for i in range(1500)] + [(None, text), (7, text)], "doc_id long, text string")
    got = substrings.deduplicated(df, block_bytes=2000).collect()
    assert len(got) == 1502
    assert sorted((r.doc_id, r.n_removed) for r in got if r.doc_id in (0, 1, 7)) == [(0, 0), (1, len(text)), (7, len(text)), (7, len(text))]
    assert [r.n_removed for r in got if r.doc_id is None] == [0]


def test_token_files(spark, docs, rows, encoded, tmp_path):
    folder = f"file://{tmp_path}/t"
    manifest = tokens.write_sequences(docs, folder, length=128, rows=4)
    got = {r.doc_id: r for r in tokens.read_documents(manifest).collect()}
    start = 0
    for i, _ in rows:
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(encoded[i]), crc(encoded[i]))
        start += len(encoded[i])
    every = [x for i, _ in rows for x in encoded[i]]
    seen = []
    for m in tokens.read_manifest(spark, folder).orderBy("file_no").collect():
        reader = tokens.SequenceReader(m.tokens_path)
        own = [x for k in range(len(reader)) for x in reader.tokens(k)[reader.mask(k)].tolist()]
        assert len(own) == m.n_tokens and all(len(reader.tokens(k)) == 128 for k in range(len(reader)))
        assert not reader.tokens(0).flags.owndata  # a view of the mapped file
        seen += own
    assert seen == every


def test_literals_of_added_tokens(spark):
    """The library's default settings: a literal of an added token is that token, and the texts after it shift."""
    t = Tokenizer.from_file(tokens.default_tokenizer())
    texts = ["plain text", "a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|><|endoftext|> é", "a <|endoftext |> b <| endoftext", "after it"]
    want = [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    assert want[1] == [64, 220, 50256, 275, 0]
    assert [tokens.encoder(tokens.default_tokenizer()).encode(x).tolist() for x in texts] == [x[:-1] for x in want]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.round_trip(df).collect()}
    assert got == {i: (sum(map(len, want[:i])), len(x), crc(x)) for i, x in enumerate(want)}
    assert sum(r.length for r in packing.packed(df).select(F.col("length")).collect()) == sum(map(len, want))


def test_packing(docs, rows, encoded):
    got = packing.packed(docs, open_windows=4, merge=2).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, _ in rows:
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(encoded[i]), crc(encoded[i][at : at + r.length]))
            at += r.length
        assert at == len(encoded[i])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) * 1024 < 1.1 * sum(map(len, encoded.values()))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (2, 40)])
def test_jaccard(docs, rows, width, percent):
    sets = {}
    for i, x in rows:
        w = re.findall(WORD, lower(x))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity.grouped(docs, width, percent).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_chunks(spark, monkeypatch):
    """A list of many different sets, compared in chunks."""
    monkeypatch.setattr(similarity, "CHUNK", 3)
    rng = random.Random(3)
    shared = " ".join(f"p{k}" for k in range(40))
    texts = [shared + " " + " ".join(f"w{rng.randrange(4)}x{k}" for k in range(8)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similarity.grouped(df, 1, 88).collect()} == brute(texts, 1, 88)


def test_jaccard_hot_groups(spark, monkeypatch):
    """A third of the rows near copies of one text, a third exact copies of another, over many batches: hot keys everywhere."""
    monkeypatch.setattr(similarity, "CHUNK", 5)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    rng = random.Random(4)
    base = [f"b{k}" for k in range(60)]
    near = [" ".join(base[:k] + [f"n{i}"] + base[k + 1 :]) for i, k in ((i, rng.randrange(60)) for i in range(40))]
    half = [" ".join(base[:40] + [f"h{i}x{k}" for k in range(rng.choice([4, 12, 30]))]) for i in range(30)]
    texts = near + half + [" ".join(f"c{k}" for k in range(50))] * 40 + ["", "w"]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    try:
        for width, percent in ((1, 90), (2, 80)):
            got = {r.doc_id: r.component_id for r in similarity.grouped(df, width, percent).collect()}
            assert got == brute([t if t else f"only {i}" for i, t in enumerate(texts)], width, percent)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_deduplicated_repeats(spark):
    """Repeated rows of one id, copies without an id, nulls and clashing names: one row of each group stays."""
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, "x"), (1, text, "y"), (2, text, "x"), (None, text, "x"), (None, text, "z"), (3, None, "x"), (4, "", "x"), (None, None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = similarity.deduplicated(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, ""), (0, text), (1, text), (3, ""), (4, "")]
    assert similarity.deduplicated(df.limit(0)).count() == 0


def brute(texts, width, percent):
    sets = [frozenset(tuple(t.split()[k : k + width]) for k in range(len(t.split()) - width + 1)) for t in texts]
    comp = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(sets)), 2):
            if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return dict(enumerate(comp))


def test_encoder_cost():
    """Random words, spelled with letters of one to three bytes: whole ids, with places of 32 bits."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdeéüñøßжщ漢字", k=rng.randint(1, 12))) + rng.choice(["", "", ",", "!?"]) for _ in range(400)) for _ in range(20)]
    coder, t = tokens.Encoder(tokens.default_tokenizer()), Tokenizer.from_file(tokens.default_tokenizer())
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tokens.np, "repeat", lambda a, n, f=np.repeat: f(a, n) if a.dtype != np.int64 else 1 / 0)
        got = list(coder.documents(pa.array([*texts, None])))
    assert np.concatenate([g[0] for g in got]).tolist() == [i for x in [*texts, ""] for i in [*t.encode(x, add_special_tokens=False).ids, 0]]


def test_memory_given_back():
    """A task's free memory goes back to the system: idle workers don't hold it beside those at work."""
    held = lambda: sum(map(int, re.findall(r"\n(?:Rss):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) >> 10
    values = (x for x in [1])
    small = [bytes(60_000) for _ in range(4000)]  # 240 MB in pieces below the size that is mapped on its own
    last = [bytes(60_000) for _ in range(2)]
    before = held()
    del small
    freed = held()
    assert list(common.released(values)) == [1]
    assert packing.TEXT_BYTES < tokens.TEXT_BYTES
    assert last and held() < before - 150 and (freed > before - 150 or held() <= freed)


def test_substring_answers_together(monkeypatch):
    """The answers of a bucket's contexts are coded together: array steps don't grow with the contexts."""
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab", k=60)) for _ in range(300)]
    contexts = [t.encode() for t in texts] + [t[:55].encode() for t in texts[:100]]
    marks = [*range(300), *range(100)]
    row = {"bucket": 0, "block": 0, "sizes": np.array([len(c) for c in contexts], "<u4").tobytes(), "bytes": b"".join(contexts), "least": np.array(range(400, 0, -1), "<i8").tobytes(), "marks": np.array(marks, "<u4").tobytes()}
    calls = []
    monkeypatch.setattr(substrings.np, "diff", lambda *a, f=np.diff, **k: calls.append(1) or f(*a, **k))
    (got,) = substrings._find(50)((pa.scalar(0),), pa.Table.from_pylist([row], schema=substrings._CONTEXTS)).to_pylist()
    counts, lengths, least = (np.frombuffer(got[c], k) for c, k in (("counts", "<u4"), ("lengths", "<u4"), ("least", "<i8")))
    want = [[min(400 - j for j, d in enumerate(contexts) if c[s : s + 50] in d) for s in range(len(c) - 49)] for c in contexts]
    assert np.repeat(least, lengths).tolist() == list(itertools.chain(*want))
    assert counts.tolist() == [1 + sum(a != b for a, b in itertools.pairwise(w)) for w in want] and len(calls) < 20


def test_quality(docs, rows, labels):
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    for i, x in rows:
        w = re.findall(WORD, x)
        seen, dup = set(), 0
        for line in x.split("\n"):
            if re.search(WORD, line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    good = [got[r.doc_id] for r in labels.where("quality = 1").collect()]
    assert sum(r.kept for r in good) >= 0.95 * sum(not r.base_failed for r in good)


def test_quality_verdict(spark):
    """The verdict against a plain walk of each tree, and what it does to good and bad documents."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest, most = quality.fitted(docs, labels)

    def path(tree, row):
        node = 0
        while (f := forest.feature[tree, node]) >= 0:
            node = 2 * node + (2 if row[f] >= forest.cut[tree, node] else 1)
        return forest.path[tree, node]

    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    for r in docs.orderBy("doc_id").limit(150).collect():
        counts, stats = quality.measured((r.text or "").encode())
        score = 2.0 ** (-np.mean([path(t, stats) for t in range(quality.TREES)]) / forest.norm)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert abs(got[r.doc_id].anomaly - score) < 1e-9 and got[r.doc_id].kept == (not failed and score <= most)
    label = {r.doc_id: r.quality for r in labels.collect()}
    kept = lambda y: [got[i].kept for i, q in label.items() if q == y and not got[i].base_failed]
    assert np.mean(kept(1)) > 0.97 and np.mean(kept(0)) < 0.2
    good, bad = np.array([0.1, 0.2, 0.3, 0.6]), np.array([0.5, 0.7, 0.8])
    assert (quality.threshold(good, bad, 1), quality.threshold(good, bad, 20), quality.threshold(bad, good, 20), quality.threshold(good, bad[:0])) == (0.3, 0.6, 1.0, 1.0)


def test_quality_without_labels(docs, labels):
    assert quality.judged(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_quality_fitted_on_all(spark):
    """Leaves and threshold are counted over all labelled rows, more than the former limit of 4,096, however they lie."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]
    text = lambda bad: " ".join(rng.choices(words[:25] if bad else words, k=rng.randint(50, 70))) + "#" * (rng.randint(0, 9) if bad else rng.random() < 0.1)
    bad = [rng.random() < 0.1 for _ in range(6000)]
    docs = spark.createDataFrame([(i, text(b)) for i, b in enumerate(bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - b) for i, b in enumerate(bad)], "doc_id long, quality int")
    forest, most = quality.fitted(docs, labels, cost=2.0)
    again = quality.fitted(docs.repartition(3), labels.repartition(2), cost=2.0)
    assert (forest.path == again[0].path).all() and (forest.cut == again[0].cut).all() and most == again[1]
    got = [r for r in quality.judged(docs, labels, cost=2.0).collect() if not r.base_failed]
    score = [np.array([r.anomaly for r in got if bad[r.doc_id] == b]) for b in (False, True)]
    assert len(got) > 5500 and 0 < most < 1 and most == quality.threshold(*score, 2.0)
    stats = np.array([r.stats for r in quality.statistics(docs).where(~quality.base_failed()).orderBy("doc_id").collect()])
    ids = sorted(r.doc_id for r in got)
    weight = np.array([min(1.0, quality.BAD_SHARE * len(score[0]) / len(score[1])) if bad[i] else 1.0 for i in ids])
    mass = np.array([np.bincount(x, weight, forest.cut.shape[1]) for x in forest.leaves(stats)])
    path = forest.path.copy()
    forest.weigh(mass)
    assert forest.cut.shape[0] == quality.TREES and np.abs(path - forest.path).max() < 1e-6


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((lambda v: v - 9 if v > 9 else v)(int(c) * (1 + k % 2)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(x):
    out = []
    for kind, p in PII.items():
        for m in re.finditer(p, x):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(n) <= 255 for n in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark, docs, rows):
    hard = ["0001.2.3.4 1.2.3.4.5.6.7.8", "a@b.c@d.e %@x.y.", "4111 1111 1111 1111 1", "1 4111111111111111", "+1+1234567890 +12345678 +(", "é" * 5 + "x@y.zz 😀 10.0.0.1", "9.9.9.9 " * 600, "12-34 " * 40]
    extra = spark.createDataFrame([(5000 + i, t, "en", "s", 0, "", "", "") for i, t in enumerate(hard)], docs.schema)
    got = {r.doc_id: r for r in pii.report(docs.unionByName(extra)).collect()}
    for i, x in [*rows, *((5000 + i, t) for i, t in enumerate(hard))]:
        want = base_spans(x)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in PII]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))


def test_pii_added_kinds_and_redaction(spark):
    text = 'pay GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33; ssn 123-45-6789, code 123-45-6780; token = "269b1cea08ffaa12"; a@b.cd'
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    spans = pii.report(df).where("doc_id = 1").first().spans.split(",")
    assert [s.split(":")[0] for s in spans] == ["email", "iban", "ssn", "secret"]
    out = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert out[2] is None and "[EMAIL]" in out[1] and "[IBAN] or GB82" in out[1] and "[SECRET]" in out[1]
    assert not base_spans(out[1])


def test_redaction_masks_what_is_found(spark):
    far = "-" * 60
    texts = [
        f"ssn 123-45-6789 {far} code 123-45-6780",
        f"ssn@x.org 123-45-6789, é 219-09-9999 {far} 219-09-9998",
        "ssn " + "x" * 39 + " a.long.address@example.org 123-45-6789",
        "password: 4012-8888-8888-1881, +1 (614) 555-8001",
        "a@b.cd é 10.0.0.1 " * 700 + "end",
        "nothing",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [(x.start, x.end, x.kind) for x in r.spans] for r in pii.found(df).collect()}
    out = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    for i, t in enumerate(texts):
        made, to = "", 0
        for start, end, kind in sorted(spans[i]):
            made += f"{t[to:start]}[{kind.upper()}]" if start >= to else ""
            to = max(to, end)
        assert out[i] == made + t[to:]
    assert out[0] == f"ssn [SSN] {far} code 123-45-6780"
    assert out[1] == f"[EMAIL] [SSN], é 219-09-9999 {far} 219-09-9998"
    assert "123-45-6789" in out[2] and out[3] == "[SECRET], [PHONE]"


@pytest.mark.parametrize("block_bytes", [1 << 24, 3000])
def test_contamination(docs, rows, bench, block_bytes):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x or ""))
    windows = {}
    for b in bench.collect():
        w = words(b.text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(b.item_id))
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, block_bytes=block_bytes).collect()}
    for i, x in rows:
        w, hit, items = words(x), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= found
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    kept = decontaminate.remove_documents(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.contaminated}
    cleaned = decontaminate.remove_spans(docs, bench, block_bytes=block_bytes)
    assert decontaminate.contamination(cleaned, bench).where("contaminated").count() == 0


def test_toxicity(docs, labels):
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert toxicity.scored(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0


@pytest.mark.parametrize("share", [0.15, 0.9])
def test_nearest_is_exact(share):
    rng = np.random.default_rng(5)
    dense = rng.random((300, 30)) * (rng.random((300, 30)) < share)
    dense[100:110] = dense[:10]  # ties
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    vectors = [(np.flatnonzero(v), v[v > 0]) for v in dense]
    index = toxicity.BlockMaxIndex(vectors, 30, 16)
    for q in range(0, 300, 7):
        ids, sims = index.nearest(*vectors[q], 10, without=np.array([q]))
        want = dense @ dense[q]
        want[q] = 0
        assert np.allclose(sims, np.sort(want[want > 0])[::-1][:10])
        order = np.lexsort((np.arange(300), -np.round(want, 12)))
        assert ids.tolist() == [i for i in order if want[i] > 0][:10]


def test_toxicity_by_brute_force(docs, rows, labels):
    """Weights, nearest examples, votes, curve and scores with dense vectors."""
    words = lambda x: re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(x))
    texts = dict(rows)
    label = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.toxic is not None and r.doc_id in texts}
    bags = {i: Counter(words(x)) for i, x in rows}
    own = sorted(label)
    terms = sorted({w for i in own for w in bags[i]})
    n1, n0 = sum(label.values()), len(own) - sum(label.values())
    frequency, with1, with0 = Counter(), Counter(), Counter()
    for i in bags:
        frequency.update(bags[i].keys())
    for i in own:
        (with1 if label[i] else with0).update(bags[i].keys())
    weight = {w: np.log1p(len(rows) / (1 + frequency[w])) * (toxicity.FLOOR + abs(np.log((with1[w] + 0.5) / (n1 + 1)) - np.log((with0[w] + 0.5) / (n0 + 1)))) for w in terms}

    def vector(i):
        v = np.array([(1 + np.log(bags[i][w])) * weight[w] if bags[i][w] else 0.0 for w in terms])
        return v / max(np.linalg.norm(v), 1e-300)

    dense = {i: vector(i) for i in bags}
    held = [i for i in own if dense[i].any()]
    matrix, y = np.array([dense[i] for i in held]), np.array([label[i] for i in held])
    share = sum(label.values()) / max(len(label), 1)
    by = np.array([(1 - share) / n0, share / n1])

    def vote(i, without=None):
        sims = matrix @ dense[i]
        if without is not None:
            sims[[k for k, j in enumerate(held) if j == without]] = 0
        best = np.argsort(-sims, kind="stable")[: toxicity.NEAREST]
        best = best[sims[best] > 0]
        w = by[y[best]] / (1.05 - sims[best])
        return float((w * y[best]).sum() / w.sum()) if len(best) else 0.0

    curve = toxicity.isotonic(np.array([vote(i, i) for i in held]), y.astype(float), by[y])
    got = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    bare = [i for i in own if not dense[i].any()]
    none = sum(by[label[i]] * label[i] for i in bare) / sum(by[label[i]] for i in bare) if bare else 0.0
    # Examples at one distance may vote in another order.
    off = [i for i in bags if abs(got[i] - (np.interp(vote(i), *curve) if dense[i].any() else none)) > 0.02]
    assert len(off) <= 0.03 * len(bags)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id")
    got = toxicity.scored(docs, labels).where("held_out").join(labels, "doc_id").select("score", "toxic").toPandas()
    ranks = got.score.rank()
    p, n = (got.toxic == 1).sum(), (got.toxic == 0).sum()
    assert (ranks[got.toxic == 1].sum() - p * (p + 1) / 2) / (p * n) > 0.95
    assert got.score[got.toxic == 0].ge(0.7).mean() < 0.01 and got.score[got.toxic == 1].ge(0.7).mean() > 0.8


def test_spans_do_not_depend_on_blocks(spark):
    """The share of hit words is judged over the whole benchmark, as many blocks as it may have."""
    rng = random.Random(8)
    items = [" ".join(f"i{n}w{rng.randrange(999)}" for _ in range(15)) for n in range(3)]
    filler = lambda n, k: " ".join(f"f{n}x{j}" for j in range(k))
    texts = [f"{items[0]} {filler(0, 200)}, {items[1]}! {filler(1, 200)}", f"{items[2]} {filler(2, 400)}", f"{items[0]} {items[1]} {filler(3, 700)}", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("starts", F.lit(1))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = [sorted((r.doc_id, r.text) for r in decontaminate.remove_spans(df, bench, block_bytes=b).collect()) for b in (1 << 24, 100)]
    assert out[0] == out[1] == [(1, f" {filler(2, 400)}"), (2, f" {filler(3, 700)}"), (3, ""), (4, "")]


def test_index_size():
    """Some 16 bytes a word beside the distinct words."""
    rng = random.Random(9)
    chunks = [(str(i), " ".join(f"w{rng.randrange(5000)}" for _ in range(4000)).encode()) for i in range(50)]
    index = decontaminate.WindowIndex(chunks, 13)
    size = index.words.nbytes + index.ends.nbytes + sum(a.nbytes + b.nbytes for a, b in index.tables.values())
    assert size < 17 * 50 * 4000


@pytest.mark.parametrize("block_bytes", [1 << 24, 40])
def test_contamination_by_items_without_id(spark, bench, block_bytes):
    words = [f"word{i}" for i in range(40)]
    items = spark.createDataFrame([(None, " ".join(words[:20])), (5, " ".join(words[20:])), (None, None)], bench.schema)
    docs = spark.createDataFrame([(1, " ".join(words[:20])), (2, " ".join(words)), (3, "word1 word2")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items, block_bytes=block_bytes).collect()}
    empty, five = (hashlib.sha256(x).hexdigest() for x in (b"", b"5"))
    assert [(got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) for i in (1, 2, 3)] == [(20, 0, empty, True), (40, 1, five, True), (0, 0, empty, False)]
    assert [r.doc_id for r in decontaminate.remove_documents(docs, items, block_bytes=block_bytes).collect()] == [3]


def test_languages(spark, docs):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = languages.identified_pages(pages, docs).collect()
    assert len(got) == pages.count() and sum(r.lang == r.declared for r in got) >= 0.95 * len(got)
    odd = spark.createDataFrame([(1, None, None), (2, "x", "<p>12</p>"), (3, "http://u@h.example.de:80/a", "<html lang=de><script>the of and</script><p>der die und ist nicht ein ich sich auch</p>")], pages.schema)
    out = {r.page_id: r for r in languages.identified_pages(odd, docs).collect()}
    assert out[1].lang is None and out[2].lang is None and (out[3].lang, out[3].host) == ("de", "h.example.de")
    kept = languages.accepted(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} >= {1000, 1001, 1002}


def test_accepted_edge_cases(spark):
    """Clashing names, repeated rows, and no language at all."""
    own = {"en": "the house of the man is on the hill", "de": "der mann und die frau sind nicht in dem haus"}
    rows = [(10 * j + i, f"{t} {t}", k, "s", 1) for j, (k, t) in enumerate(own.items()) for i in range(5)]
    rows += [(1, rows[1][1], "en", None, 2), (None, own["en"], None, "s", 3), (77, None, "en", "s", 4), (78, "12 !", "de", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row_id int")
    kept = languages.accepted(df)
    assert kept.columns == df.columns and sorted(r.row_id for r in kept.collect()) == [1] * 10 + [2, 3]
    unknown = df.withColumn("lang", F.lit(None).cast("string"))
    assert languages.accepted(unknown).count() == 12


def test_all_languages_count(spark):
    """Each language has words of its own; the rarest, beyond the 64th, is told as well."""
    syllables = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in "vzxqj"]
    own = lambda i: " ".join(syllables[(i * 3 + j) % 275] * 2 + syllables[(i * 3 + j) % 275] for j in range(3))
    texts = [(10 * i + j, f"{own(i)} " * 8, f"l{i:02}", "s") for i in range(70) for j in range(1 if i == 69 else 2)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    model = languages.fitted(df)
    assert model.languages == [f"l{i:02}" for i in range(70)]
    assert {r.row_id for r in languages.fused(languages.document_rows(df, F.col("doc_id")), model).where("lang = 'l69'").collect()} == {690}
    assert languages.fitted(df, fit_docs=1).languages == model.languages


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    texts = ["Copyright (c) 2020 A. Nyone\n\n" + mit.replace("sublicense", "sub-license").upper(), "intro\nreleased under the MIT licence!\nend", "MIT", None, "Licensed under CC BY-NC 4.0."]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted((r.doc_id, r.license_id) for r in got.collect()) == [(0, "MIT"), (1, "MIT"), (4, "CC-BY-NC-4.0")]


def test_entire_licenses(spark):
    """Entire texts are found, those of like licences are told apart, and a table of one's own is read."""
    full = dict(licenses.full_texts())
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(full)
    bsd = next(t for i, t in licenses.full_texts() if i == "BSD-3-Clause")
    texts = [(f"Copyright 2001 A. Nyone\n\n{t}", i) for i, t in full.items()] + [("Copyright (c) 2020, B\n" + " ".join(bsd.split()).replace('"', "'").upper(), "BSD-3-Clause")]
    df = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.license_id) for r in licenses.scan(df).collect())
    assert got == [(n, i) for n, (_, i) in enumerate(texts)]
    own = spark.createDataFrame([("Own-1", "You may do as you like.\n\nNo warranty."), ("Own-2", None)], "license_id string, text string")
    got = licenses.scan(spark.createDataFrame([(1, "you may do\nas you like.\n\nNO warranty"), (2, "no warranty")], "doc_id long, text string"), own)
    assert [tuple(r) for r in got.collect()] == [(1, "Own-1", 1)]


EMPTY = {
    "substrings": lambda d, b, l: substrings.deduplicated(d), "tokens": lambda d, b, l: tokens.round_trip(d), "similarity": lambda d, b, l: similarity.grouped(d), "quality": lambda d, b, l: quality.judged(d, l),
    "pii": lambda d, b, l: pii.report(d), "contamination": lambda d, b, l: decontaminate.contamination(d, b), "packing": lambda d, b, l: packing.packed(d), "toxicity": lambda d, b, l: toxicity.scored(d, l),
    "languages": lambda d, b, l: languages.accepted(d), "licenses": lambda d, b, l: licenses.scan(d),
}


@pytest.mark.parametrize("name", sorted(EMPTY))
def test_empty_tables(docs, bench, labels, name):
    assert EMPTY[name](docs.limit(0), bench.limit(0), labels.limit(0)).count() == 0
