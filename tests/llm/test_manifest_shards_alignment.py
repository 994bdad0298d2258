"""Merkle manifest, rendezvous sharding and tokenizer alignment against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ringside.llm import alignment, merkle, ranks, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos long, total string, batch long, shard int"


@pytest.fixture(scope="module")
def rows():
    """With nulls in every column, empty and long texts, repeated rows and ids, and columns named as the operators' own."""
    rng = random.Random(3)
    out = []
    for i in range(260):
        text = "\n".join("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 4)))
        out.append((i, text, rng.choice(["en", None]), rng.choice(["a", "b", "b", "b", "ß", "Z", None]), len(text)))
    out += [(300, None, None, "one", None), (301, "", "en", "", 0), (None, "x\ny", "en", "b", 3), (7, "other text", "en", "b", 1),
            (302, "y\n" * 90_000, "de", "b", None), out[5], out[5], (None, None, None, None, None)]
    return [(*r, 1, "t", 2, 3) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    i, text, lang, source, n = row[:5]
    parts = [None if v is None else str(v) for v in (i, source, lang, n, text)]
    return H("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in parts))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, at):
    for level in tree[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        yield run[: at % 3], run[at % 3 + 1 :]
        at //= 3


def plain_manifest(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[1] for x in sorted(((r[0] is not None, r[0] or 0), leaf_of(r)) for r in rows if r[3] == s)]) for s in sources}
    crown = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        own = sorted((r for r in rows if r[3] == s), key=lambda r: ((r[0] is not None, r[0] or 0), leaf_of(r)))
        for at, r in enumerate(own):
            proof = [*siblings(trees[s], at), *siblings(crown, k)]
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf_of((r[0], text, *r[2:]))
            for left, right in proof:
                node = H("".join(left) + node + "".join(right))
            out.append((r[0], leaf_of(r), trees[s][-1][0], crown[-1][0],
                        H("".join("".join(left + right) for left, right in proof)), node, node == crown[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("height", [1, 2, merkle.HEIGHT])
def test_manifest_equals_plain_trees(docs, rows, height):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = merkle.verify(merkle.manifest(docs, {"text": text}, height))
    assert Counter(tuple(r) for r in got.collect()) == plain_manifest(rows)


def test_witnesses_grow_with_every_append():
    nodes = [hashlib.sha256(bytes([i])).digest() for i in range(25)]
    for n in range(1, 26):
        tree = merkle.OpenTree()
        for node in nodes[:n]:
            tree.append(node)
        root = tree.finish(merkle.height_of(n))
        plain = levels([x.hex() for x in nodes[:n]])
        assert root.hex() == plain[-1][0]
        for i in range(n):
            assert bytes(tree.witnesses[i]).hex() == "".join("".join(a + b) for a, b in siblings(plain, i))
            assert merkle.fold(nodes[i], bytes(tree.witnesses[i]), [(i, n)]) == root


def test_a_changed_field_breaks_its_own_proof_only(docs):
    for field, value in (("lang", F.lit("xx")), ("n_chars", F.lit(-1)), ("source", F.lit("moved"))):
        changed = F.when(F.col("doc_id") == 11, value).otherwise(F.col(field))
        got = merkle.verify(merkle.manifest(docs, {field: changed}))
        assert {r.doc_id for r in got.where("not verified").collect()} == {11}


def test_manifest_of_nothing_and_of_one_row(docs):
    assert merkle.verify(merkle.manifest(docs.limit(0))).count() == 0
    (one,) = merkle.verify(merkle.manifest(docs.where("doc_id = 302"))).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified
    assert one.proof_sha256 == H("")


def test_positions_are_gapless_with_ties_and_nulls(spark):
    data = [(g, v) for g in ("a", None) for v in [5] * 40 + [None] * 3 + list(range(9))]
    df = spark.createDataFrame(data, "g string, v long").repartition(7)
    got = ranks.positions(df, ["g"], ["v"], "test-ranks").collect()
    for g in ("a", None):
        mine = sorted((r.pos, r.v) for r in got if r.g == g)
        assert [p for p, _ in mine] == list(range(52)) and all(r.total == 52 for r in got)
        assert [v for _, v in mine] == sorted((v for h, v in data if h == g), key=lambda v: (v is not None, v))


def test_shards_follow_the_law(spark, docs, rows):
    weights = dict.fromkeys(range(40), 1.0)
    got = sharding.shard(docs, weights, {40: 1.0}).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    homes, slots = defaultdict(set), defaultdict(list)
    for r in got:
        homes[r.doc_id].add((r.shard, r.grown_shard))
        slots[r.shard].append((r.slot, (r.doc_id is not None, r.doc_id or 0)))
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(len(h) == 1 for h in homes.values())
    for listed in slots.values():
        listed.sort()
        assert [s for s, _ in listed] == list(range(len(listed))) and [k for _, k in listed] == sorted(k for _, k in listed)
    # what 41 shards give at once
    again = sharding.shard(docs, dict.fromkeys(range(41), 1.0)).collect()
    assert {(r.doc_id, r.shard) for r in again} == {(r.doc_id, r.grown_shard) for r in got}
    assert sharding.shard(docs.limit(0), weights).count() == 0


def test_weights_are_kept_and_few_keys_move(spark):
    keys = spark.range(30_000).withColumnRenamed("id", "doc_id")
    place = lambda w: {r.doc_id: r.s for r in keys.select("doc_id", sharding.assign(F.col("doc_id"), w).alias("s")).collect()}
    base = {0: 1.0, 1: 2.0, 2: 5.0}
    first = place(base)
    counts = Counter(first.values())
    assert all(abs(counts[s] / 30_000 - w / 8) < 0.012 for s, w in base.items())
    wider = place({**base, 1: 4.0})
    moved = [(first[k], wider[k]) for k in first if first[k] != wider[k]]
    assert all(b == 1 for _, b in moved) and abs(len(moved) / 30_000 - (4 / 10 - 2 / 8)) < 0.015
    less = place({0: 1.0, 2: 5.0})
    assert all(less[k] == s for k, s in first.items() if s != 1)
    with pytest.raises(ValueError):
        sharding.assign(F.col("doc_id"), {0: 0.0})


def test_shard_files_hold_every_row_once(spark, docs, tmp_path):
    weights = {0: 1.0, 1: 3.0}
    sharding.write_shards(docs, str(tmp_path / "shards"), weights, file_rows=40)
    back = spark.read.parquet(str(tmp_path / "shards"))
    plain = lambda df: Counter(map(str, df.collect()))
    assert plain(back.select(docs.columns)) == plain(docs)
    assert back.where(F.col("shard_") != sharding.assign(F.col("doc_id"), weights)).count() == 0
    assert len(list((tmp_path / "shards" / "shard_=1").glob("*.parquet"))) > 2


ODD = [
    (1, "a <|endoftext|> b </s> <s><0x41>"), (2, ""), (3, None), (4, "  two  spaces "), (5, "x" * 60_000),
    (6, "日本語テキスト emoji 🎉 naïve"), (7, "▁under"), (8, "tab\tnew\nline"), (9, "é   nbsp  ﬁ"), (10, "same text"),
    (11, "same text"), (11, "same text"), (12, "\x00nul"), (13, " lead"), (14, "trail "), (None, "no id, it's"),
]


def plain_alignment(data, a_path, b_path):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(a_path)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_bytes, b_bytes = alignment.ByteSide(a_path).pieces, alignment.PieceSide(b_path).pieces
    found, count = [], Counter()
    for i, text in data:
        if not text:
            found.append((i, None))
            continue
        spans = []
        for ids, known in ((a_side.encode(" " + text, add_special_tokens=False).ids, a_bytes), (b_side.encode(text), b_bytes)):
            at, out = 0, []
            for t in ids:
                out.append((at, at + len(known[t]), t))
                at += len(known[t])
            spans.append((out, b"".join(known[t] for t in ids)))
        (a, a_text), (b, b_text) = spans
        if not a_text == b_text == (" " + text).encode():
            found.append((i, None))
            continue
        linked, j = [], 0
        for s, e, t in a:
            while b[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][0] < e:
                linked.append((t, b[k][2]))
                k += 1
        groups, low = [], 0
        for end in sorted({e for _, e, _ in a} & {e for _, e, _ in b}):
            groups.append("|".join(",".join(str(t) for s, e, t in side if low <= s and e <= end) for side in (a, b)))
            low = end
        count.update(set(linked))
        found.append((i, (len(a), len(b), len(groups), linked, H(";".join(groups)))))
    top = Counter()
    for (t, _), n in count.items():
        top[t] = max(top[t], n)
    return Counter(
        (i, 0, 0, 0, 0, 0, 0, "") if f is None else
        (i, *f[:3], len(f[3]), sum(count[p] == top[p[0]] for p in f[3]), sum(count[p] for p in f[3]), f[4]) for i, f in found)


@pytest.fixture(scope="module")
def tokenizers_():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("batch", [64, alignment.BATCH])
def test_alignment_equals_plain_spans(spark, sf_dir, tokenizers_, batch):
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in ODD + [(i + 100, t) for i, t in data]],
                               "doc_id long, text string, batch long, pairs int").repartition(4)
    out, pairs = alignment.aligned(df, *tokenizers_, batch)
    assert Counter(tuple(r) for r in out.collect()) == plain_alignment(ODD + [(i + 100, t) for i, t in data], *tokenizers_)
    best = pairs.groupBy("a_id").agg(F.max("count").alias("n"), F.max(F.when(F.col("best"), F.col("count"))).alias("m"))
    assert best.where("n <> m").count() == 0


def test_alignment_of_nothing(spark, tokenizers_):
    out, pairs = alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), *tokenizers_)
    assert out.count() == pairs.count() == 0
    out, pairs = alignment.aligned(spark.createDataFrame([(1, None)], "doc_id long, text string"), *tokenizers_)
    assert [tuple(r) for r in out.collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
