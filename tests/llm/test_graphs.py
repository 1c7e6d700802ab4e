"""Near-duplicate, search and link operators against brute force, and their edge cases."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldspark.llm import aq, graph, linkgraph, neargraph, simhash
from fieldspark.llm.graph import components, unite
from fieldspark.llm.registered import RULES

from ..oracle import plain, sql_rows

import duckdb


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    parent = np.arange(3000)
    unite(parent, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: parent[n] for n in {x for a, b in edges if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_of_a_long_text():
    rng = np.random.default_rng(17)
    words = [f"W{k}" for k in rng.integers(0, 50_000, 450_000)]
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).lower().encode(), 42) for i in range(len(words) - 2)], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
    assert simhash.fingerprint(" ".join(words).encode(), 3) == sum(1 << b for b in range(64) if 2 * int(ones[b]) > len(hashes))


def test_gray_index_finds_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    near = [base]
    for _ in range(3):
        moved = base.copy()
        for _ in range(3):
            moved ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
        near.append(moved)
    codes = np.unique(np.concatenate(near))
    index = simhash.GrayIndex(codes)
    found = {(int(q), int(index.order[p])) for qs, ps in index.search(codes, 3) for q, p in zip(qs, ps)}
    a, b = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None]) <= 3)
    assert found == set(zip(a.tolist(), b.tolist()))
    parent = np.arange(len(codes))
    unite(parent, a, b)
    roots = simhash.local_roots(codes)
    assert len(set(zip(roots.tolist(), parent.tolist()))) == len(set(parent.tolist())) == len(set(roots.tolist()))


@pytest.mark.parametrize("crowd", [simhash.CROWD, 3])
def test_simhash_rows(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.RADIUS, crowd))
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(50)]
    texts = []
    for _ in range(30):
        words = list(rng.choice(vocabulary, 120))
        texts.append(" ".join(words))
        for _ in range(3):
            own = words.copy()
            own[rng.integers(0, 120)] = "changed"
            texts.append(" ".join(own))
    texts += [texts[0]] * 40 + ["", None, "one", "ONE", "One two"]
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in enumerate(texts)], "doc_id long, text string, fp string, component_id int")
    fps = np.array([brute_fingerprint(t, 3) for t in texts], np.uint64)
    parent = np.arange(len(texts))
    unite(parent, *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3))
    rows = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs, 3).collect()}
    assert rows == {k: (int(f), int(p)) for k, (f, p) in enumerate(zip(fps, parent))}
    assert simhash.near_duplicates(docs.where("doc_id < 0"), 3).collect() == []


@pytest.mark.parametrize("full", [simhash.FULL, 20])
def test_similar_groups(spark, full, monkeypatch):
    monkeypatch.setattr(simhash, "FULL", full)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts, group = [], []
    for g in range(25):
        words = list(rng.choice(vocabulary, 300))
        for _ in range(4):
            own = words.copy()
            own[rng.integers(0, 300)] = "changed"
            texts.append(" ".join(own)), group.append(g)
    texts += ["", None, texts[0]]
    group += [98, 98, 0]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, row long")
    rows = {r.doc_id: r.representative for r in simhash.similar_groups(docs).collect()}
    assert rows == {k: group.index(g) for k, g in enumerate(group)}


@pytest.mark.parametrize("sets", [simhash.SETS, 3])
def test_similar_groups_verify_the_similarity(spark, sets, monkeypatch):
    monkeypatch.setattr(simhash, "SETS", sets)
    rng = np.random.default_rng(14)
    texts, group = [], []
    for g in range(60):
        words = [f"w{k}" for k in rng.integers(0, 10**6, 300)]
        own = words.copy()
        # 48 new words in a row leave a similarity of 0.70, and 27 leave 0.81.
        wide = 48 if g < 30 else 27
        own[100 : 100 + wide] = [f"v{k}" for k in rng.integers(0, 10**6, wide)]
        texts += [" ".join(words), " ".join(own)]
        group += [2 * g, 2 * g + 1 if g < 30 else 2 * g]
    line = " ".join(f"x{k}" for k in range(20))
    texts += [" ".join([line] * 3), " ".join([line] * 40)]
    group += [120, 120]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, row long")
    assert {r.doc_id: r.representative for r in simhash.similar_groups(docs).collect()} == dict(enumerate(group))


def vectors_frame(spark, vectors, labels):
    rows = [(k, None if v is None else [None if x is None else float(x) for x in v], l, 7, "x") for k, (v, l) in enumerate(zip(vectors, labels))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n int, node string")


def sample_vectors():
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 16))
    near = [base, base[:20] + 0.05 * rng.standard_normal((20, 16)), base[:1].repeat(40, 0), base[1:2] + 0.02 * rng.standard_normal((30, 16))]
    good = np.concatenate(near).astype(np.float32)
    odd = [None, np.zeros(16), [None] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    return [*good, *odd], good


def brute_links(good, labels, threshold=neargraph.THRESHOLD):
    wide = good.astype(float)
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    near = (unit @ unit.T >= threshold) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("cell", [neargraph.CELL, 40])
def test_neargraph_rows(spark, cell):
    vectors, good = sample_vectors()
    labels = np.zeros(len(vectors), int)
    labels[:60] = np.arange(60) % 2
    labels[60:80] = np.arange(20) % 2
    labels[110:150] = 1
    frame = vectors_frame(spark, vectors, labels.tolist()).unionByName(spark.createDataFrame([(500, [1.0] * 16, None), (501, [1.0] * 16, None)], "vec_id long, embedding array<float>, label int"), allowMissingColumns=True)
    near = brute_links(good, labels[: len(good)])
    parent = np.arange(len(good))
    unite(parent, *np.nonzero(near))
    rows = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neargraph.near_duplicates(frame, cell=cell).collect()}
    want = {k: (int(near[k].sum()), int(parent[k]), bool(parent[k] == k)) for k in range(len(good))}
    assert {k: rows[k] for k in want} == want
    alone = [k for k in rows if k >= len(good)]
    assert len(alone) == 8 and all(rows[k] == (0, k, True) for k in alone)
    assert neargraph.near_duplicates(frame.where("vec_id < 0")).collect() == []


@pytest.mark.parametrize("cell", [40, 150])
def test_neargraph_loses_no_link_across_borders(spark, cell):
    rng = np.random.default_rng(13)
    base = rng.standard_normal((250, 24))
    good = np.concatenate([base, base + 0.25 * rng.standard_normal((250, 24)), base[:30]]).astype(np.float32)
    near = brute_links(good, np.zeros(len(good), int))
    parent = np.arange(len(good))
    unite(parent, *np.nonzero(near))
    rows = {r.vec_id: (r.n_links, r.component_id) for r in neargraph.near_duplicates(vectors_frame(spark, good, [0] * len(good)), cell=cell).collect()}
    assert near.sum() > 400
    assert rows == {k: (int(near[k].sum()), int(parent[k])) for k in range(len(good))}


def test_neargraph_of_many_cells_equals_brute_force(spark):
    """Some sixty cells in one label, a dense blob that no centre parts, and labels of other kinds."""
    rng = np.random.default_rng(16)
    base = rng.standard_normal((2000, 16))
    good = np.concatenate([base, base[:700] + 0.2 * rng.standard_normal((700, 16)), base[:1] + 0.03 * rng.standard_normal((300, 16))]).astype(np.float32)
    near = brute_links(good, np.zeros(len(good), int))
    parent = np.arange(len(good))
    unite(parent, *np.nonzero(near))
    rows = {r.vec_id: (r.n_links, r.component_id) for r in neargraph.near_duplicates(vectors_frame(spark, good, [0] * len(good)), cell=100).collect()}
    assert near.sum() > 80_000
    assert rows == {k: (int(near[k].sum()), int(parent[k])) for k in range(len(good))}


def test_neargraph_widens_where_recall_falls_short(monkeypatch):
    rng = np.random.default_rng(18)
    base = rng.standard_normal((200, 24))
    vectors = np.concatenate([base + 0.15 * rng.standard_normal((200, 24)) for _ in range(12)])
    monkeypatch.setattr(neargraph, "LADDER", ((1, 1, 1), neargraph.LADDER[1]))
    widths = []
    search = neargraph.range_search
    monkeypatch.setattr(neargraph, "range_search", lambda *args: widths.append(args[-1]) or search(*args))
    monkeypatch.setattr(neargraph, "RANDOM", 0)
    links, _, recall = neargraph.cell_links(vectors, np.ones(len(vectors), np.int64), shard=400)
    true = neargraph.unit(vectors) @ neargraph.unit(vectors).T >= 0.93
    assert set(widths) == {1, neargraph.LADDER[1][2]} and recall >= neargraph.AUDIT
    assert links.sum() >= 0.99 * (true.sum() - len(vectors))


def test_neargraph_recall_without_fallback():
    rng = np.random.default_rng(8)
    base = rng.standard_normal((3000, 32))
    points = neargraph.unit(np.concatenate([base, base[:600] + 0.1 * rng.standard_normal((600, 32))]))
    graph = neargraph.united(points, rng, 800)
    some = np.arange(3000, 3600)
    true = np.zeros((600, len(points)), bool)
    true[neargraph._full(points, some, 0.93)] = True
    got = np.zeros_like(true)
    got[neargraph.range_search(points, *graph, some, 0.93)] = True
    assert (true & got).sum() >= 0.9 * true.sum()


def test_aq_recall_beyond_the_shortlist(spark):
    """16,384 rows in one block: 400 of them reach the exact ranking."""
    rng = np.random.default_rng(19)
    centres = rng.standard_normal((200, 32))
    good = (centres[rng.integers(0, 200, 16_384)] + 0.5 * rng.standard_normal((16_384, 32))).astype(np.float32)
    rows = aq.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(good)], "vec_id long, embedding array<float>"), F.col("vec_id") % 256 == 0, 20).collect()
    wide = good.astype(float)
    hits = 0
    for q in range(0, len(good), 256):
        score = wide @ wide[q]
        score[q] = -np.inf
        hits += len({r.vec_id for r in rows if r.query_id == q} & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.97 * 20 * 64


def test_aq_rows_and_recall(spark):
    rng = np.random.default_rng(9)
    good = rng.standard_normal((2000, 32)).astype(np.float32)
    good[300:340] = good[5]
    vectors = [*good, None, np.zeros(32), [None] * 32, [1.0, 2.0]]
    frame = vectors_frame(spark, vectors, [0] * len(vectors))
    rows = aq.nearest(frame, F.col("vec_id") % 20 == 0, 20, rows_block=700, query_block=30).collect()
    wide = good.astype(float)
    hits = total = 0
    for q in range(0, 2000, 20):
        own = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [v for _, v, _ in own]
        assert all(s == pytest.approx(wide[q] @ wide[v], abs=1e-9) for _, v, s in own)
        assert own == sorted(own, key=lambda x: (-x[2], x[1]))
        score = wide @ wide[q]
        score[q] = -np.inf
        hits += len({v for _, v, _ in own} & set(np.lexsort((np.arange(2000), -score.round(9)))[:20].tolist()))
        total += 20
    assert hits >= 0.9 * total
    few = aq.nearest(frame.where("vec_id < 6"), F.col("vec_id") % 20 == 0, 20).collect()
    assert len(few) == 5
    assert aq.nearest(frame.where("vec_id < 0"), F.col("vec_id") % 20 == 0, 20).collect() == []


PAGES = [
    (0, "http://a.net/x", '<a href="http://good.org/fr/">g</a> <img src="//spam.com/p">'),
    (1, "https://good.org/fr/1", "<a href='http://friend.com/a'>f</a><a href=\"HTTP://FRIEND.com/b\">f</a>"),
    (2, "http://friend.com/a?x=/de/", '<a href="/local">l</a>'),
    (3, "http://linker.com/", '<a href="http://a.net/x">n</a>'),
    (4, "http://www.Example.com/de/page#f", None),
    (5, "http://www.example.com/fr/page", ""),
    (6, "http://example.net/en/", "<p>"),
    (7, "http://example.net", "x"),
    (8, None, "<a href='http://a.net/'>"),
    (9, "no scheme", None),
    (10, "ftp://", ""),
    (10, "ftp://", ""),
    (11, "http://notexample.net/en/a", ""),
    (12, "http://linker.com/b", '<a href="http://a.net/y"><a href="http://b.net/y">'),
]


def test_linkgraph_rows(spark):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, rule string, trust int")
    found = linkgraph.verdicts(pages, linkgraph.rule_table(spark, RULES))
    rows = {r.page_id: r for r in found.collect()}
    assert found.count() == len(PAGES)
    assert rows[0].verdict == "block" and rows[0].rule == "net/" and rows[1].rule == "org/fr/"
    assert (rows[4].host, rows[4].path, rows[4].rule) == ("www.example.com", "/de/page", "example.com/de/") and rows[6].rule == "example.net/en/" and rows[7].rule is None
    assert (rows[8].host, rows[8].path, rows[9].host, rows[10].host) == ("", "", "", "") and rows[11].rule == "net/"
    assert rows[3].distrust > 0 and rows[2].trust > 0 and rows[2].verdict == "allow"
    db = duckdb.connect()
    table = pages.select("page_id", "url", "html").toArrow()
    db.register("pages", table)
    names = ["host", "page_id", "path", "rule", "verdict"]
    mine = sorted((tuple(plain(r[n]) for n in names) for r in found.collect()), key=str)
    assert sql_rows(db, linkgraph.oracle(RULES))[1] == mine
    # Its links alone decide on a host without rules: two lead to blocked hosts.
    assert rows[3].verdict == rows[12].verdict == "block"
    assert linkgraph.verdicts(pages.where("page_id < 0"), linkgraph.rule_table(spark, RULES)).collect() == []


def plain_ranks(hosts, links):
    """Trust and distrust by loops over hosts and links."""
    ranks = []
    for seed, a, b in ((0, 0, 1), (1, 1, 0)):
        rank = {h: (1 - linkgraph.DAMPING) * s[seed] for h, s in hosts.items()}
        total = {}
        for link in links:
            total[link[a]] = total.get(link[a], 0) + link[2]
        for _ in range(linkgraph.ROUNDS):
            got = {}
            for link in links:
                got[link[b]] = got.get(link[b], 0.0) + rank.get(link[a], 0.0) * link[2] / total[link[a]]
            rank = {h: (1 - linkgraph.DAMPING) * hosts.get(h, (0, 0))[seed] + linkgraph.DAMPING * got.get(h, 0.0) for h in {*hosts, *got}}
        ranks.append(rank)
    return ranks


def test_host_ranks_equal_a_plain_loop(spark):
    rng = np.random.default_rng(15)
    hosts = {f"h{k}": ((1.0, 0.0), (0.0, 1.0), (0.5, 0.25), (0.0, 0.0))[k % 4] for k in range(30)}
    links = [(f"h{a}", f"h{b}", int(n)) for (a, b), n in {(int(a), int(b)): n for a, b, n in zip(rng.integers(0, 36, 90), rng.integers(0, 36, 90), rng.integers(1, 5, 90)) if a != b}.items()]
    found = linkgraph.host_ranks(spark.createDataFrame([(h, *s) for h, s in hosts.items()], "host string, trusted double, blocked double"), spark.createDataFrame(links, "src string, dst string, n long"))
    trust, distrust = plain_ranks(hosts, links)
    rows = {r.host: (r.trust, r.distrust) for r in found.collect()}
    assert all(rows.get(h, (0, 0)) == (pytest.approx(trust.get(h, 0.0), abs=1e-12), pytest.approx(distrust.get(h, 0.0), abs=1e-12)) for h in {*trust, *distrust})


def test_links_alone_flip_verdicts(spark):
    """Distrust blocks a host that rules don't know; trust from a good host outweighs it again."""
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    base = [(1, "http://bad.net/", ""), (2, "http://good.org/fr/a", ""), (3, "http://unknown.com/", link("bad.net")), (4, "http://farther.com/", link("unknown.com")), (5, "http://lone.com/", link("nowhere.com"))]
    rules = linkgraph.rule_table(spark, RULES)

    def judged(pages):
        return {r.page_id: r.verdict for r in linkgraph.verdicts(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}

    unlinked = judged([(k, u, "") for k, u, _ in base])
    assert unlinked == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow"}
    assert judged(base) == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow"}
    # A good host's trust outweighs the unknown one's half of the distrust that the bad host hands back.
    vouched = judged([*base, (6, "http://else.com/", link("bad.net")), (7, "http://good.org/fr/b", link("unknown.com"))])
    assert vouched[3] == "allow" and vouched[6] == "block" and vouched[1] == "block"


@pytest.mark.parametrize("common, block", [(simhash.COMMON, simhash.BLOCK), (3, 4)])
def test_similar_groups_lose_no_link_that_signatures_miss(spark, common, block, monkeypatch):
    monkeypatch.setattr(simhash, "COMMON", common)
    monkeypatch.setattr(simhash, "BLOCK", block)
    # Neither bands nor the index propose anything: what differs by a bit counts as too far apart.
    monkeypatch.setattr(simhash, "LOOSE", -1)
    monkeypatch.setattr(simhash, "links", lambda classes, *_: classes.select("fp", F.col("fp").alias("other")).where("false"))
    rng = np.random.default_rng(21)
    sentence = " ".join(f"s{k}" for k in range(12))
    texts = []
    for size in (6, 9, 14, 30, 45, 90, 300):
        for _ in range(4):
            words = [f"w{k}" for k in rng.integers(0, 60 if size < 10 else 10**6, size)]
            for change in (0, 1, max(1, size // 45), size // 25 + 1):
                own = words.copy()
                at = rng.integers(0, size)
                own[at : at + change] = [f"v{k}" for k in rng.integers(0, 10**6, len(own[at : at + change]))]
                texts.append(" ".join([*own, sentence] if size > 10 else own))
    texts += ["", None, sentence, f"{sentence} more", f"{sentence} s0"]
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    parent = np.arange(len(texts))
    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or len(x & sets[j]) >= 0.8 * len(x | sets[j]) > 0:
                unite(parent, np.array([i]), np.array([j]))
    assert 20 < len(np.unique(parent)) < len(texts) - 20
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, row long")
    assert {r.doc_id: r.representative for r in simhash.similar_groups(docs).collect()} == dict(enumerate(parent.tolist()))


def test_missed_makes_no_row_for_each_pair(spark, monkeypatch):
    # A shingle with a small hash is in all prefixes; the texts share nothing else.
    shared = min((f"c{k} c c c c" for k in range(2000)), key=lambda t: int(simhash.shingle_hashes(t.encode(), 5)[0]))
    texts = [f"{shared} " + " ".join(f"w{n}x{k}" for k in range(20)) for n in range(150)]
    sizes, written = {}, simhash.written

    def counted(df, label):
        found = written(df, label)
        sizes[label] = found.count()
        return found

    monkeypatch.setattr(simhash, "written", counted)
    docs = spark.createDataFrame([(k, t.encode(), k) for k, t in enumerate(texts)], "node long, text binary, grp long")
    assert simhash.missed(docs, 5, 0.8).isEmpty()
    assert sizes["met"] >= len(texts)
    assert max(sizes.values()) <= sizes["prefixes"] < 10 * len(texts)


def test_components_of_few_edges_equal_those_of_many(spark, monkeypatch):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (250, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7), (None, 3), (3, None)]
    edges = spark.createDataFrame(edges, "a long, b long")
    few = components(edges)
    monkeypatch.setattr(graph, "FEW", 0)
    assert sorted(few.collect()) == sorted(components(edges).collect())
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
