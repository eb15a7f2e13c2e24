"""Operators 11, 12 and 13 against plain re-computations and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from isobar.llm import alignment, phrases, sharding

CLASHES = "doc_id long, text string, lang string, block long, a long, b long, name string, word string, row int, part int, key string, shard int, pair int, doc int, size string, kept int"


def table(spark, rows):
    """Documents with columns whose names the operators might use themselves."""
    return spark.createDataFrame([(i, t, lang, 1, 2, 3, "n", "w", 4, 5, "k", 6, 7, 8, "s", 9) for i, t, lang in rows], CLASHES)


# --- phrases ----------------------------------------------------------------------------------

def plain_phrases(rows, least, most, covered=100):
    f = defaultdict(Counter)
    for text, lang in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(words[i: i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for g, c in own.items() if len(g) == 1)
        longer = defaultdict(int)
        candidates = {g: c for g, c in own.items() if len(g) > 1 and c >= least}
        for g, c in candidates.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    longer[g[i: i + m]] = max(longer[g[i: i + m]], c)
        rows = []
        for g, a in candidates.items():
            if not (longer[g] and 100 * longer[g] >= covered * a):
                score, k = min((1000 * a * n // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


def made_texts(seed, n):
    rnd = random.Random(seed)
    words = ["the", "old", "Harbour", "keeps", "its", "lanterns", "É", "日本", "x y", "\x1c", "'s"]
    fixed = ["the old harbour keeps its lanterns", "its its its its its its"]
    def text():
        parts = [rnd.choice(fixed) if rnd.random() < 0.3 else " ".join(rnd.choices(words, k=rnd.randint(0, 9))) for _ in range(rnd.randint(0, 6))]
        return rnd.choice([" ", "\t", ". ", "\n", "\x0b", "  ;"]).join(parts)
    return [(text(), rnd.choice(["en", "de", None])) for _ in range(n)] + [(None, "en"), ("", None), ("a " * 3000, "en"), (". , ;", "fr")]


@pytest.mark.parametrize("least, most, covered", [(3, 2000, 100), (3, 7, 100), (5, 2000, 60)])
def test_phrases(spark, least, most, covered):
    rows = made_texts(least + most, 150)
    df = table(spark, [(i % 7 or None, t, lang) for i, (t, lang) in enumerate(rows)]).repartition(5)
    got = phrases.phrases(df, least, most, covered)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint")
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, least, most, covered)


def test_phrase_blocks_are_bounded(monkeypatch):
    """Blocks of a few texts give the same pairs, block by block."""
    pa = pytest.importorskip("pyarrow")
    monkeypatch.setattr(phrases, "BLOCK", 100)
    monkeypatch.setattr(phrases, "TaskContext", type("One", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})())}))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 30), pa.array(["one two three, four five"] * 30)], names=["lang", "text"])
    blocks = list(phrases._numbered(iter([batch])))
    assert [b["block"][-1].as_py() for b in blocks] == list(range(3 << 8, (3 << 8) + len(blocks))) and len(blocks) > 3
    assert sum(n for b in blocks for n in b["n"].to_pylist() if n) == 150


def test_rows_do_not_grow_with_blocks(spark, monkeypatch):
    """What many blocks share is one row, and each block gets one answer of each shard."""
    made, stored = Counter(), phrases.stored
    def counted(df, name, *more):
        out = stored(df, name, *more)
        made[name] = out.count()
        return out
    monkeypatch.setattr(phrases, "stored", counted)
    monkeypatch.setattr(phrases, "SHARD", 1 << 12)
    text = " ".join(f"w{i}" for i in range(400))
    got = phrases.phrases(spark.createDataFrame([("en", text)] * 32, "lang string, text string").repartition(16), 20)
    shards, blocks = 1 + 32 * len(text) // (1 << 12), 16
    assert got.count() == 396 and all(made[f"hits{k}"] <= 400 + shards * blocks < 400 * 10 for k in range(1, 6))
    assert all(made[f"phrases{k}"] <= blocks * (shards + 2) < 400 * 10 for k in range(1, 6))


def test_packed_numbers_and_pairs():
    rng = np.random.default_rng(3)
    arrays = [rng.integers(0, 1 << b, n) for b, n in ((1, 9), (8, 300), (31, 0), (33, 70), (62, 5))] + [np.zeros(4, np.int64)]
    back = phrases._unpacked(pa.scalar(phrases._packed(*arrays, b"raw \xff", arrays[1].astype(np.int32))))
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(arrays, back)) and back[6].tobytes() == b"raw \xff" and (back[7] == arrays[1]).all()
    for names, shards in ((1, 1), (2, 3), (50, 7), (1000, 1), ((1 << 31) - 1, 900)):
        a, b = (np.unique(x) if names < 100 else x for x in rng.integers(0, names, (2, 4000)))
        a, b = (x.ravel() for x in np.meshgrid(a, b)) if names < 100 else (a, b)
        mixed = phrases._Mixed(names, shards)
        x = mixed.mixed(a, b)
        assert len(np.unique(x)) == len(set(zip(a.tolist(), b.tolist()))) and (np.diff(mixed.shard(np.sort(x)).astype(np.int64)) >= 0).all()
        assert all((u == v).all() for u, v in zip(mixed.pairs(x), (a, b))) and int(mixed.shard(x).max()) < shards
        if names >= 1000:
            assert np.bincount(mixed.shard(x).astype(np.int64), minlength=shards).max() < 4000 / shards * 4 + 12
    with pytest.raises(RuntimeError):
        phrases._Mixed(1 << 32, 1)


def test_scores_beyond_64_bits(spark):
    """Frequencies of 10^9 in 10^13 words: 1000 a n has 25 digits."""
    a, n = 10**9 + 7, 10**13 + 1
    levels = [spark.createDataFrame([(1, 1, "en", "p", 3 * a), (2, 2, "en", "q", 2 * a + 1)], "name long, here long, lang string, word string, f long"),
              spark.createDataFrame([(1, 1, 1, 2, a)], "name long, here long, a long, b long, f long")]
    total = spark.createDataFrame([("en", n)], "lang string, total long")
    (row,) = phrases._scored(levels, total, 100).collect()
    assert (row.phrase, row.l, row.r, row.score) == ("p q", 3 * a, 2 * a + 1, 1000 * a * n // (3 * a * (2 * a + 1)))


# --- shards -----------------------------------------------------------------------------------

def plain_capacity(sizes, shards):
    def needed(capacity):
        n, s = 1, 0
        for size in sizes:
            if s and s + size > capacity:
                n, s = n + 1, 0
            s += size
        return n
    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(mid) <= shards else (mid + 1, high)
    return low


def check_shards(rows, shards, got):
    groups = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    sizes = [sum(len((rows[i][1] or "").encode()) + 16 for i in groups[k]) for k in sorted(groups)]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots, total, of = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
        of[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())
    order = [min(of[zlib.crc32((rows[groups[k][0]][1] or "").encode())]) for k in sorted(groups)]
    assert order == sorted(order)  # runs of groups
    assert max(total.values()) <= max(plain_capacity(sizes, shards), max(sizes))
    assert set(total) == set(range(min(shards, len(groups))))


@pytest.mark.parametrize("n, shards, cells", [(300, 7, 16), (300, 40, 1 << 14), (12, 40, 16), (400, 1, 8), (1, 3, 4)])
def test_shards_are_the_smallest(spark, monkeypatch, n, shards, cells):
    monkeypatch.setattr(sharding, "CELLS", cells)
    rnd = random.Random(n + shards)
    rows = [(rnd.choice([None, i, 5]), None if rnd.random() < 0.05 else "hot " * 300 if rnd.random() < 0.3 else "é" * int(rnd.paretovariate(0.9) * 3) + str(rnd.random())) for i in range(n)]
    check_shards(rows, shards, sharding.shard(table(spark, [(i, t, "en") for i, t in rows]).repartition(3), shards).collect())


def test_cells_bound_what_they_hide():
    rnd = random.Random(5)
    sums = np.cumsum([rnd.randint(1, 50) for _ in range(500)]).tolist()
    cells = sharding.Cells([(part[0], part[-1], len(part)) for part in (sums[i: i + 9] for i in range(0, 500, 9))])
    for x in range(0, sums[-1] + 20, 7):
        low, high = cells.floor(x)
        assert low <= max([s for s in sums if s <= x], default=0) <= high
        low, high = cells.after(x)
        assert low <= min([s for s in sums if s > x], default=sums[-1]) <= high or x >= sums[-1]


def test_no_shards(spark):
    with pytest.raises(ValueError):
        sharding.shard(table(spark, []), 0)


# --- alignment --------------------------------------------------------------------------------

PATHS = ("byte_bpe_50k.json", "piece_bpe_32k.model")
ODD = ["  a  b ", "a\n\nb", "x\r\ny", "a \r b;\r\n c", "▁x y", "a\x00b", "\x1cz a \x1c b", "a\x85 b　　 c", "a ", "  ", " ", "\n", "\t\ta", "<s> <|endoftext|> </s><0x41>", "é é",
       "a  b\xa0 c", "\r", "a\r b", "a\r\r b", None, "", "".join(chr(97 + (i * i * 7919 >> 3) % 26) for i in range(3000)), "don't 's  'll\n've", "a\n \n  b", "日本語 テキスト", "\U0001f600 ok"]


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(public_tokenizers.path(PATHS[0]))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PATHS[1]))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)}
    found, docs = [], Counter()
    for text in texts:
        a, b = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        raw = [[bytes(byte[c] for c in a_side.id_to_token(i)) for i in a],
               [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]]
        if not text or any(b"".join(x) != (" " + text).encode() for x in raw):
            found.append(None)
            continue
        ends = [np.cumsum([len(t) for t in x]).tolist() for x in raw]
        cuts, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for c in cuts:
            m, n = ends[0].index(c, i) + 1, ends[1].index(c, j) + 1
            groups.append((a[i:m], b[j:n]))
            i, j = m, n
        links = Counter((u, v) for x, y in groups for u in x for v in y)
        docs.update(links.keys())
        digest = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(digest.encode()).hexdigest()))
    best = defaultdict(int)
    for (u, _), n in docs.items():
        best[u] = max(best[u], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else (*x[:3], sum(x[3].values()), sum(m for p, m in x[3].items() if docs[p] == best[p[0]]), sum(m * docs[p] for p, m in x[3].items()), x[4]) for x in found]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


@pytest.mark.parametrize("block", [1 << 25, 2000])
def test_alignment(spark, texts, block):
    pytest.importorskip("sentencepiece")
    rows = ODD + texts[:120] + texts[:5]
    df = table(spark, [(i % 50 or None, t, "en") for i, t in enumerate(rows)]).repartition(3)
    got = alignment.align(df, *map(public_tokenizers.path, PATHS), block=block).collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == Counter((i % 50 or None, *w) for i, w in enumerate(plain_alignment(rows)))


def test_packed_bits():
    rnd = random.Random(1)
    at = np.array(sorted(rnd.sample(range(1000), 300)))
    other = np.array(sorted(rnd.sample(range(1000), 400)))
    a, b = alignment.Packed(1000, at), alignment.Packed(1000, other)
    assert (a & b).places().tolist() == sorted(set(at.tolist()) & set(other.tolist()))
    probe = np.arange(1000)
    assert a.rank(probe).tolist() == np.searchsorted(at, probe, "right").tolist()


def test_large_stretches_are_counted_by_distinct_tokens(monkeypatch):
    """Stretches of many tokens on both sides: the same pairs, whichever way they are expanded."""
    units = alignment.Units(type("Two", (), {"a_sizes": np.array([1, 3]), "b_bytes": [b"ab", b"abab"], "b_sizes": np.array([2, 4]),
                                             "ids": lambda self, units: ([[0] + [1] * 1999 + [0, 0] for _ in units], [[0, 1, 0] * 750 for _ in units])})())
    units.sides.b_bytes = [b"aa", b"aaaa"]
    units.place["a" * 6000]
    units.learn()
    assert units.sizes[:, 0].tolist()[:2] == [2002, 2250] and int(units.times.sum()) == units.sizes[3, 0]


# --- all three --------------------------------------------------------------------------------

def test_empty_tables(spark):
    docs = table(spark, []).limit(0)
    assert phrases.phrases(docs).count() == 0 and sharding.shard(docs, 4).count() == 0
    assert alignment.align(docs, *map(public_tokenizers.path, PATHS)).count() == 0


def test_queries_are_their_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    for run, sql in ((phrases.op11_phrases, phrases.OP11_SQL), (sharding.op12_minimax_shards, sharding.OP12_SQL)):
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert Counter(map(tuple, run(spark, sf_dir).select(*names).collect())) == Counter(cur.fetchall())
