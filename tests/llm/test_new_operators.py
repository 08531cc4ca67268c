"""op11 to op13 against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabweave.llm import alignment, oracles, prefix_trie, queries, url_filter

TURNS = "conv_id long, turn long, role string, text string, words string, lo long, hi long, turns string, n long, s_hi long"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "w", 1, 2, "t", 3, 4) for r in rows], TURNS)


def brute_trie(rows, family=20, shared=4):
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, own in convs.items():
        h, head = zlib.crc32(str(c).encode()) % shared, c - int(math.fmod(c, family))
        made[c] = own if head == c else convs.get(head, [])[:h] + own[h:]
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for k, members in nodes.items():
        below = [(x, m) for x, m in nodes.items() if x[: len(k)] == k]
        kids = lambda x: [y for y in nodes if len(y) == len(x) + 1 and y[: len(x)] == x]
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        ends = ",".join(str(c) for c in sorted(c for c in members if len(made[c]) == len(k)))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids(k)), sum(not kids(x) for x, _ in below), sum((len(m) - 1) * words(x) for x, m in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some_turns(seed, n=70, vocabulary=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 130), n):
        rows += [(c, t, rng.choice(["user", None]), rng.choice(["a b", "c", "d e f", "", None][:vocabulary])) for t in rng.sample([None, *range(9)], rng.randint(1, 6))]
    return rows


@pytest.mark.parametrize("stretch, turns_a_shard", [(1 << 18, 1 << 20), (7, 5)])
def test_trie_matches_brute_force(spark, monkeypatch, stretch, turns_a_shard):
    """In one shard a task, and in shards of a few turns whose upper nodes are merged."""
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns_a_shard)
    # a deep conversation with a copy, a copied conversation, turnless rebuilds, ids without a head, negative and huge ids
    rows = some_turns(1) + [(c, t, "user", "same") for c in range(200, 260) for t in range(2)] + [(c, t, "x", "y z") for c in (301, 300) for t in range(60)]
    rows += [(-7, 1, "u", "a b"), ((1 << 62) + 1, 1, "u", "a b"), (None, 1, "u", "lost"), (401, 0, "u", "only"), (402, 0, "u", "only"), (403, 0, "u", "only")]
    got = prefix_trie.conversation_trie(turns(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie(rows)


def test_trie_of_few_turns(spark):
    assert prefix_trie.conversation_trie(turns(spark, [])).count() == 0
    rows = [(5, 0, None, None), (5, 0, None, None), (None, 0, "u", "x")]
    assert [tuple(r) for r in prefix_trie.conversation_trie(turns(spark, rows)).orderBy("depth").collect()] == sorted(brute_trie(rows), key=lambda r: r[1])


def test_trie_equals_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    cur = con.execute(oracles.PREFIX_TRIE)
    names = [d[0] for d in cur.description]
    got = queries.op11_prefix_trie(spark, sf_dir).select(*names).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(cur.fetchall(), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_double_array_holds_exactly_its_sequences(seed):
    rng = random.Random(seed)
    seqs = sorted({tuple(rng.randint(1, 40) for _ in range(rng.randint(0, 6))) for _ in range(300)})
    labels, at = np.array([x for s in seqs for x in s]), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    trie = prefix_trie.DoubleArray(labels, at)
    slots = trie.walked()
    prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}
    assert (trie.check > 0).sum() == len(prefixes) - 1 and len(set(slots)) == len(prefixes) - 1
    for prefix in prefixes:
        here = prefix_trie.ROOT
        for x in prefix:
            here = trie.base[here] + x
        for x in range(1, 41):
            to = trie.base[here] + x
            child = 0 < to < len(trie.check) and trie.check[to] == here
            assert child == (prefix + (x,) in prefixes)


# ---------------------------------------------------------------- url filter


def brute_split(run, model, total):
    cost = lambda w: math.log(total) - math.log(model[w]) if w in model else math.log(total) - math.log(10) + len(w) * math.log(10)
    splits = []
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(run)]
        splits.append([run[a:b] for a, b in zip(at, at[1:])])
    return min(sum(map(cost, s)) for s in splits), cost


def test_runs_split_as_cheaply_as_any(spark):
    model = {"free": 50, "bets": 20, "be": 90, "ts": 10, "casino": 30, "win": 40, "in": 200, "so": 5, "é": 3}
    runs = ["freebets", "casinowin", "winso", "xyz", "freexbets", "betsé", "i", "0"]
    total = sum(model.values())
    got = dict(url_filter.segmented(spark.createDataFrame([(r,) for r in runs], "run string"), spark.createDataFrame(list(model.items()), "word string, n long")).collect())
    assert got["freebets"] == ["free", "bets"] and got["casinowin"] == ["casino", "win"] and got["0"] == ["0"]
    for run in runs[:-1]:
        best, cost = brute_split(run, model, total)
        assert "".join(got[run]) == run and sum(map(cost, got[run])) == pytest.approx(best)


def judge(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = ["http://WWW.Example.NET/en/1?x=/de/", "https://example.com/de", "https://example.com/de/3#/", "http://a.org/fr/?q", "http://org/fr/", "net/", None, "", "ftp://x.net", "a://b://c/d", "http://notexample.net/en/", "http://example.net:80/en/", "http://É.org/fr/é", "https://example.com/de/\nx", "://net/"]


def test_rules_by_hand(spark):
    pages = spark.createDataFrame([(k % 9 or None, u, "<p>Some text", "k", 1, "h") for k, u in enumerate(URLS * 2)], "page_id long, url string, html string, key string, n long, host string")
    rows = url_filter.url_filter(pages).collect()
    assert len(rows) == 2 * len(URLS)
    want = Counter((k % 9 or None, *judge(u, url_filter.RULES)) for k, u in enumerate(URLS * 2))
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in rows) == want
    assert all(r["verdict"] in ("allow", "block") and r["score"] is not None for r in rows)
    assert url_filter.url_filter(pages.limit(0)).count() == 0


def test_bayes_matches_plain_counts(spark, sf_dir):
    """Scores equal those of a plain naive Bayes over the words that the operator split."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = url_filter.url_filter(pages).collect()
    assert len(rows) == pages.count()
    model = Counter()
    for r in pages.collect():
        text = re.sub(r"(?is)<(script|style)\b.*?(?:</\1\b|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*>", " ", r["html"])
        model.update(re.findall(r"[^\W\d_]+", text.lower()))
    assert {r["word"]: r["n"] for r in url_filter.visible_words(pages, "html").collect()} == model
    runs = lambda s: re.findall(r"[^\W\d_]+|0", re.sub("[0-9]+", "0", s).lower())
    for r in rows:
        joined = runs(r["host"])
        assert "".join(joined) == "".join(r["host_words"])
    # paths of these pages hold known words only, so their runs are their words
    bags = [(list(r["host_words"]), runs(r["path"]), any(w in url_filter.SEEDS for w in r["host_words"])) for r in rows]
    bad, good = Counter(), Counter()
    for host, path, blocked in bags:
        (bad if blocked else good).update(host + path)
    words = len({*bad, *good})
    odds = lambda w: math.log((bad[w] + 1) / (sum(bad.values()) + words + 1)) - math.log((good[w] + 1) / (sum(good.values()) + words + 1))
    n_bad = sum(b for *_, b in bags)
    prior = math.log(n_bad + 1) - math.log(len(bags) - n_bad + 1)
    for r, (host, path, _) in zip(rows, bags):
        assert r["score"] == pytest.approx(prior + sum(map(odds, host + path)), abs=1e-5)
        if r["rule"] is None:
            assert r["verdict"] == ("block" if r["score"] > 0 else "allow")
    assert 0 < n_bad < len(bags)


def test_concatenated_hosts_are_caught(spark):
    """Held-out names that only hang together with taught words are judged by them."""
    rng = random.Random(3)
    bad, good = ["casino", "bets", "win", "jackpot", "lucky"], ["garden", "travel", "school", "music", "river"]
    taught = [f"http://{w}-{rng.choice(bad)}.com/{rng.choice(['play', 'spin'])}/{k}" for k in range(80) for w in rng.sample(bad[:2], 1)] + [f"http://{'-'.join(rng.sample(good, 2))}.com/{rng.choice(['read', 'news'])}/{k}" for k in range(300)]
    held = {f"http://{a}{b}.com/{p}/{k}": v for k in range(30) for v, names, ps in (("block", bad[2:], ["play", "spin"]), ("allow", good, ["read", "news"])) for a, b, p in [(*rng.sample(names, 2), rng.choice(ps))]}
    rows = [(k, u, "<p>words of a page") for k, u in enumerate([*taught, *held])]
    got = {r["path"] + r["host"]: r["verdict"] for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string"), rules=()).collect()}
    right = [got[judge(u, ())[1] + judge(u, ())[0]] == v for u, v in held.items()]
    assert sum(right) / len(right) >= 0.9


# ---------------------------------------------------------------- alignment


@pytest.mark.parametrize("seed", range(6))
def test_gallop_gives_ranks(seed):
    rng = np.random.default_rng(seed)
    hay = np.unique(rng.integers(0, 10 ** rng.integers(1, 6), rng.integers(0, 3000)))
    needles = np.unique(rng.integers(0, 10 ** rng.integers(1, 6), rng.integers(0, 2000)))
    assert (alignment.gallop(needles, hay) == np.searchsorted(hay, needles)).all()
    ia, ib, _ = alignment.common(needles, hay)
    _, wa, wb = np.intersect1d(needles, hay, return_indices=True)
    assert (ia == wa).all() and (ib == wb).all()


def test_overlaps_by_hand():
    first, last = alignment.overlaps(np.array([2, 5, 6]), np.array([1, 2, 4, 6]))
    assert first.tolist() == [0, 2, 3] and last.tolist() == [1, 3, 3]


@pytest.fixture(scope="module")
def vocabularies():
    pytest.importorskip("public_tokenizers")
    return queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


def brute_alignment(texts, a_path, b_path):
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(a_path)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
    letter = alignment._byte_letters()
    docs, counts = [], Counter()
    for t in texts:
        a = b = ()
        if t:
            a = [(k, bytes(letter[c] for c in tok.id_to_token(k))) for k in tok.encode(" " + t, add_special_tokens=False).ids]
            b = [(k, bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace("▁", " ").encode()) for k in sp.encode(t) for p in [sp.id_to_piece(k)]]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + t).encode():
                a = b = ()
        ends = lambda tokens: list(itertools.accumulate(len(x) for _, x in tokens))
        ea, eb = ends(a), ends(b)
        both = sorted({*ea} & {*eb})
        groups = [([k for (k, _), e in zip(a, ea) if lo < e <= hi], [k for (k, _), e in zip(b, eb) if lo < e <= hi]) for lo, hi in zip([0, *both], both)] if len(a) < 3000 else None
        links = [(dict(zip(ea, (k for k, _ in a)))[e], dict(zip(eb, (k for k, _ in b)))[e]) for e in both] if len(a) < 3000 else [(x, y) for da, db in [(dict(zip(ea, (k for k, _ in a))), dict(zip(eb, (k for k, _ in b))))] for x, y in [(da[e], db[e]) for e in both]]
        counts.update(links)
        docs.append((len(a), len(b), len(both), links, groups))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    told = lambda groups: hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest() if groups else ""
    return [(na, nb, n, len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), None if groups is None else told(groups)) for na, nb, n, links, groups in docs]


ODD_TEXTS = [None, "", " ", "  two  blanks ", "a\nb\r\n\tc", "<|endoftext|> </s> <unk> <0x41> ▁x", "naïve café “q” x’s — ü", "中文字 テスト 한국어 עברית", "🙂👍🏽 e\u0301", "\u0378\ue000\x00\x1c", "a" * 4000, "x y z " * 30, "x y z " * 30, "İstanbul ẞ Ω \u00a0 \u2028 \u3000"]


@pytest.mark.parametrize("slab", [4 << 20, 600])
def test_alignment_matches_brute_force(spark, plain, vocabularies, monkeypatch, slab):
    monkeypatch.setattr(alignment, "SLAB", slab)
    texts = [*ODD_TEXTS, *[t for t in plain.values() if t and len(t) < 6000][:80]]
    df = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, slab string, pos long, n long").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.cross_tokenizer_alignment(df, *vocabularies).collect()}
    want = brute_alignment(texts, *vocabularies)
    assert len(got) == len(texts)
    for k, w in enumerate(want):
        assert got[k][:6] == w[:6] and (w[6] is None or got[k][6] == w[6]), texts[k]


def test_alignment_of_odd_rows(odd, odd_rows, empty, vocabularies):
    got = alignment.cross_tokenizer_alignment(odd, *vocabularies).collect()
    want = brute_alignment([t for _, t, _ in odd_rows], *vocabularies)
    assert Counter((r["doc_id"], *tuple(r)[1:7]) for r in got) == Counter((d, *w[:6]) for (d, _, _), w in zip(odd_rows, want))
    assert alignment.cross_tokenizer_alignment(empty, *vocabularies).count() == 0


def test_groups_put_texts_together_again(spark, plain, vocabularies):
    tables = alignment._Tables(*vocabularies)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ODD_TEXTS)], "doc_id long, text string")
    for r in alignment.aligned_groups(rows, *vocabularies).collect():
        if not r["a_ids"]:
            continue
        whole = (" " + ODD_TEXTS[r["doc_id"]]).encode()
        for ids, cuts, spelt in ((r["a_ids"], r["a_cuts"], tables.a.bytes), (r["b_ids"], r["b_cuts"], tables.b.bytes)):
            parts = [b"".join(spelt[k] for k in ids[lo:hi]) for lo, hi in zip([0, *cuts], cuts)]
            assert b"".join(parts) == whole and list(itertools.accumulate(map(len, parts))) == r["byte_cuts"]
