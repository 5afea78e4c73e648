"""Merkle manifest, byte-pair encoding and conversation trie against plain restatements."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lorebase.llm import bpe, merkle, prefix_trie, toxicity, url_filter
from lorebase.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pid string"
TALK = "conv_id long, turn long, role string, text string, depth string, ka string"


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows.toArrow())
    return con.sql(sql).fetchall()


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = [(i, f"Text {rng.random()} É", "en", f"s{i % 3}" if i < 300 else f"t{i}", i, "x", "y") for i in range(340)]
    rows += [(None, "A", None, None, None, "x", "y"), (5, None, "en", None, 3, "x", "y"), (7, "", None, "", None, "x", "y"), (3, "Z" * 300_000, "en", "s0", 1, "x", "y")]
    rows += [(9, "Same", "en", "s1", 4, "x", "y")] * 40 + [(9, "Other", "en", "s1", 4, "x", "y")]
    return spark.createDataFrame(rows, DOCS).cache()


def folded(rows):
    """The manifest of (doc_id, source, leaf) by recursion: root, and each leaf's siblings."""
    order = lambda r: (r[0] is not None, r[0] or 0, r[2])
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))

    def tree(nodes):  # (digest, members): members are (leaf number, siblings so far)
        while len(nodes) > 1:
            above = []
            for a in range(0, len(nodes), 16):
                run = nodes[a : a + 16]
                for k, (_, members) in enumerate(run):
                    for m in members:
                        m[1] += "".join(d for j, (d, _) in enumerate(run) if j != k)
                above.append((hashlib.sha256("".join(d for d, _ in run).encode()).hexdigest(), [m for _, members in run for m in members]))
            nodes = above
        return nodes[0]

    tops, leaves = [], []
    for s in sources:
        mine = [[r, ""] for r in sorted((r for r in rows if r[1] == s), key=order)]
        leaves += mine
        digest, members = tree([(m[0][2], [m]) for m in mine])
        tops.append((digest, members))
    root, _ = tree(tops)
    return root, [(r[0], r[1], r[2], hashlib.sha256(p.encode()).hexdigest()) for r, p in leaves]


def test_merkle(spark, docs):
    got = merkle.op11_report(docs).collect()
    assert plain(got) == plain(by_sql(merkle.ORACLE, documents=docs.drop("leaf", "pid")))
    changed = {r.doc_id for r in docs.collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text and r.text != "".join(c.lower() if c.isascii() else c for c in r.text)}
    assert {r.doc_id for r in got if not r.verified} == changed
    assert merkle.op11_report(docs.where("false")).count() == 0
    one = merkle.op11_report(docs.where("doc_id = 5 and source is null")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == hashlib.sha256().hexdigest()


def test_merkle_parts(spark, docs):
    """Parts of few rows, whose runs cross their borders, against a recursion; merging in any order."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        m = merkle.build(docs, Scratch(spark), part_rows=11)
        assert len(m.plan) > 20 and m.runs
        root, want = folded([(r.doc_id, r.source, r.leaf) for r in merkle.audit(m).collect()])
        assert root == m.root and plain(want) == plain(merkle.audit(m).select("doc_id", "source", "leaf", "proof_sha256").collect())
        proof = merkle.audit(m, with_proof=True).first()
        assert hashlib.sha256(proof.proof.encode()).hexdigest() == proof.proof_sha256
        assert merkle.subroots(m).agg(F.sum("rows")).first()[0] == docs.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rng, size = random.Random(1), 1000
    leaf = [hashlib.sha256(str(i).encode()).digest() for i in range(size)]
    whole = merkle.grow(0, b"".join(leaf), size)
    for _ in range(5):
        cuts = sorted({0, size, *(rng.randrange(size) for _ in range(9))})
        forests = [({(0, level, i): d for level, i, d in merkle.grow(a, b"".join(leaf[a:b]), size)[1]}, {0: size, merkle.TOP: 1}, {}) for a, b in zip(cuts, cuts[1:])]
        rng.shuffle(forests)
        out = forests[0]
        for f in forests[1:]:
            out = merkle.merge_forests(out, f)
        assert out[0] == {(merkle.TOP, 0, 0): whole[0][-1][1]}


@pytest.fixture(scope="module")
def model():
    return bpe.read_model()


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.MODEL)


def test_bpe_texts(spark, model):
    t, rng = library(), random.Random(5)
    parts = ["a", "'", "s", "'re", "é", "e", "́", "̧", "1", "ß", "日", "!", "<|endoftext|>", "Σ", "가", "ᅡ", "　", "İ", "ing", " ", "\n", "\x1c", "՘"]
    texts = ["", "  ", None, "Hello  World's", "x" * 30_000, *("".join(rng.choice(parts) for _ in range(rng.randrange(400))) for _ in range(150))]
    want = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    rows = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(texts)], "doc_id long, text string, ids string")
    got = bpe.encode(rows, model).orderBy("doc_id").collect()
    assert [r.ids for r in got] == [None if x is None else w.ids for x, w in zip(texts, want)]
    back = bpe.decode(bpe.encode(rows, model), model, into="again").orderBy("doc_id").collect()
    assert [r.again for r in back] == [None if x is None else t.decode(w.ids, skip_special_tokens=False) for x, w in zip(texts, want)]
    report = {r.doc_id: r for r in bpe.op12_report(rows.unionByName(rows), model).collect()}
    for i, w in enumerate(want):
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (report[i].n_tokens, report[i].ids_sha256, report[i].decoded_sha256) == (len(w.ids), sha(" ".join(map(str, w.ids))), sha(t.decode(w.ids, skip_special_tokens=False)))
    assert bpe.op12_report(rows.where("false"), model).count() == 0
    assert bpe.decode_ids(t.encode("Dé jà vu!", add_special_tokens=False).ids, model, library=False) == "dé jà vu ! "


def test_bpe_streams(model, monkeypatch):
    """Pieces and blocks of any size give the same ids, with a buffer no longer than the lookahead and a block."""
    t, rng = library(), random.Random(2)
    some = [x.removesuffix(bpe.END) for x in model.tokens if x.removesuffix(bpe.END).isascii() and x.removesuffix(bpe.END).isalpha()]
    words = ["".join(rng.choice(pool) for _ in range(4000)) for pool in (some, ["in", "th", "an", "er", "a", "t", "h", "e"])] + ["a" * 20_000, "ab" * 9000, "日本" * 3000 + "'s"]
    texts = [*words, " ".join(words), "!" * 9000 + "'re" + "x" * 9000]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(bpe, "BLOCK", 64)
    monkeypatch.setattr(bpe, "LONG", 50)
    monkeypatch.setattr(bpe.pieces, "__defaults__", (3000,))
    monkeypatch.setattr(bpe.normalized_pieces, "__defaults__", (500,))
    assert [x.tolist() for x in bpe.encode_texts(texts, model)] == want
    stream = bpe.WordStream(model)
    out = []
    for a in range(0, len(words[0]), 37):
        out += stream.feed(words[0][a : a + 37].lower().encode())
        assert len(stream.held) < model.look + 64 + 37
    assert [*out, *stream.finish()] == want[0]


def test_lookahead_is_of_the_rules():
    assert bpe.lookahead([("a", "b")]) == 2
    # bc may become (ab)c or a(bc): what follows b decides about a
    assert bpe.lookahead([("b", "c"), ("a", "b"), ("a", "bc")]) == 3
    with pytest.raises(ValueError):
        bpe.lookahead([("ab", "c"), ("a", "b")])


def talk(spark, rng, n, extra=()):
    """Conversations that begin alike, some ids missing, some copies."""
    said = ["yes", "no", "é", "", None]
    rows = []
    for c in [i for i in range(-3, n) if i % 7 != 5]:
        for k in range(rng.randrange(1, 8)):
            rows.append((c, k if k else None, rng.choice(["user", None, "bot"]) if rng.random() < 0.2 else "user", rng.choice(said) if rng.random() < 0.4 else "yes", "x", "y"))
    return spark.createDataFrame(rows + list(extra), TALK)


def test_trie(spark, monkeypatch):
    rng = random.Random(11)
    extra = [(None, 1, "user", "lost", "x", "y"), (3, 2, "user", "yes", "x", "y"), (3, 2, "user", "yes", "x", "y"), (205, 1, "user", "w" * 100_000, "x", "y")]
    rows = talk(spark, rng, 260, extra).cache()
    want = plain(by_sql(prefix_trie.ORACLE, conversations=rows.drop("depth", "ka")))
    assert plain(prefix_trie.op13_report(rows).collect()) == want and len(want) > 100
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 1)
    assert plain(prefix_trie.op13_report(rows.repartition(9)).collect()) == want
    assert prefix_trie.op13_report(rows.where("false")).count() == 0


def test_trie_of_conversations_as_they_are(spark):
    """Against a dictionary of prefixes."""
    rows = talk(spark, random.Random(3), 40).cache()
    paths: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.turn is not None, r.turn or 0)):
        paths.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    members: dict = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    want = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(x[: len(q)] == q and x != q for x in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        want.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    scratch = Scratch(spark)
    assert plain(prefix_trie.prefix_trie(*prefix_trie.as_they_are(rows, scratch), scratch).collect()) == plain(want)


def test_long_words_and_urls(spark):
    """A fitted model on a word of a megabyte, and a url of 16 MB."""
    import numpy as np

    m = toxicity.Model(0.1, toxicity.Kernel(toxicity.windows(["idiot", "stupid"])[0]), np.ones((2, 2)), np.zeros(2), np.array([1.0, 0, 0, -1]))
    word = "".join(random.Random(4).choice("abcdefgh") for _ in range(3000))
    whole = m.word_scores([word, "stupid"])
    before, toxicity.WINDOW_ROWS = toxicity.WINDOW_ROWS, 100
    try:
        assert np.array_equal(m.word_scores([word, "stupid"]), whole)
    finally:
        toxicity.WINDOW_ROWS = before
    assert 0 < m.score(["abcdefgh" * (1 << 17)])[0] < 1
    pages = spark.range(40).selectExpr("id page_id", "concat('http://x.', if(id % 2 = 0, 'com/fr/', 'com/de/'), id) url")
    big = spark.range(1).select(F.lit(99).cast("long").alias("page_id"), F.concat(F.lit("http://q.net/"), F.repeat(F.lit("abcdefgh"), F.lit(2 << 20))).alias("url"))
    got = {r.page_id: r for r in url_filter.judge(pages.unionByName(big)).collect()}
    assert len(got) == 41 and got[99].rule is None and np.isfinite(got[99].score)


def test_urls_are_cut_without_a_seam():
    import numpy as np

    rng = random.Random(6)
    urls = [b"http://a.b/c", b"x", bytes(rng.randrange(97, 123) for _ in range(700))]
    gram, of = url_filter._grams(urls)
    for size in (7, 100, 1 << 20):
        parts = list(url_filter._pieces(urls, size))
        assert np.array_equal(np.concatenate([p[0] for p in parts]), gram) and np.array_equal(np.concatenate([p[1] for p in parts]), of)
