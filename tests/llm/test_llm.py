"""The training-text operators against brute force, exact round trips and edge cases."""

import hashlib
import io
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")
tokenizers_home = pytest.importorskip("public_tokenizers")

from tallyforge.llm import bpe, html_extract, langid, linededup, metric_join, packing, simhash, topk, toxicity, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, fingerprint int"


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def components(ids, linked):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_simhash_components(spark):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    texts = [" ".join(base)] * 3 + [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 120, 2)] + [None, "", " \n", "One", "one"] + [" ".join(f"v{rng.randint(0, 99)}" for _ in range(30)) for _ in range(20)]
    docs = spark.createDataFrame([(k, t, "en", 0) for k, t in enumerate(texts)], DOCS)
    for limit in (simhash.CELL_LIMIT, 1):  # pairing, and the way for crowded cells
        distinct = {simhash._signed(simhash.fingerprint(t)) for t in texts}
        fps = spark.createDataFrame([(x,) for x in distinct], "fp long")
        links = {(r.a, r.b) for r in simhash.fingerprint_links(fps, cell_limit=limit).collect()}
        near = [(a, b) for a, b in itertools.combinations(distinct, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
        assert components(distinct, links) == components(distinct, near) or limit == 1 and _same(components(distinct, links), components(distinct, near))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    fp = [simhash.fingerprint(t) for t in texts]
    low = components(range(len(texts)), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (fp[a] ^ fp[b]).bit_count() <= 2])
    assert got == {k: (f"{fp[k]:016x}", low[k]) for k in range(len(texts))}
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_one_row_per_component(spark):
    rng = random.Random(7)
    alone, twice, nameless, mixed = (" ".join(f"{k}{rng.randint(0, 999)}" for _ in range(40)) for k in "abcd")
    rows = [(None, alone), (1, twice), (1, twice), (2, twice), (None, nameless), (None, nameless), (None, mixed), (9, mixed), (8, mixed), (5, None), (None, "")]
    docs = spark.createDataFrame([(k, t, "en", n) for n, (k, t) in enumerate(rows)], DOCS)
    kept = [(r.doc_id, r.text) for r in simhash.keep_one_per_component(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, alone), (1, twice), (None, nameless), (8, mixed), (5, None)], key=str)
    assert simhash.keep_one_per_component(docs.withColumnRenamed("lang", "Row")).columns == ["doc_id", "text", "Row", "fingerprint"]
    assert simhash.keep_one_per_component(docs.limit(0)).count() == 0


def _same(a, b):
    groups = lambda c: {frozenset(k for k in c if c[k] == v) for v in c.values()}
    return groups(a) == groups(b)


def test_line_dedup(spark):
    rng = random.Random(2)
    line = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(34, 60)))
    lines = [line() for _ in range(12)]
    for x in lines[:8]:
        y = list(x)
        for _ in range(rng.randint(1, 3)):
            y[rng.randrange(len(y))] = "z"
        lines.append("".join(y))
    texts = ["\n".join(rng.choice([*lines, "", "short", "shirt"]) for _ in range(rng.randint(0, 6))) for _ in range(40)] + [None, "", "short\n\nshort"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in linededup.dedup_lines(spark.createDataFrame([(k, t, "en", 0) for k, t in enumerate(texts)], DOCS)).collect()}
    seen, want = [], {}
    for k, t in enumerate(texts):
        if t is None:
            want[k] = (None, 0, 0)
            continue
        kept = []
        for x in t.split("\n"):
            if x.strip() and any(x == s or len(x) >= 30 and len(s) >= 30 and lev(x, s) <= 2 for s in seen):
                continue
            kept.append(x)
            if x.strip():
                seen.append(x)
        # a line that was dropped still counts as an earlier line
        seen += [x for x in t.split("\n") if x.strip() and x not in seen]
        want[k] = ("\n".join(kept), len(t.split("\n")), len(kept))
    assert got == want


def test_line_families(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(60))
    near = [base[:k] + "z" + base[k + 1 :] for k in range(60)]  # all within two edits of each other
    shared = [base[:20] + "".join(rng.choice("stuvwxyz") for _ in range(40)) for _ in range(80)]  # share a segment, nothing else
    slots = [f"order number {rng.randint(0, 10**6):06d} of the customer with the long name" for _ in range(60)]
    lines = near + shared + slots
    rng.shuffle(lines)
    got = linededup.dedup_lines(spark.createDataFrame([(k, t, "en", 0) for k, t in enumerate(lines)], DOCS)).collect()
    want = {k: any(x == t or lev(x, t) <= 2 for x in lines[:k]) for k, t in enumerate(lines)}
    assert {r.doc_id: r.n_kept == 0 for r in got} == want


def test_clashing_columns_and_odd_rows(spark):
    """Null and repeated ids, repeated rows, empty tables, a very long text and columns named like the operators' own."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(None, "the one line of a text that is long enough\nx", 1, "a"), (None, None, 2, "b"), (3, "", 3, "c"), (3, "", 3, "c"), (4, long, 4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, stay string").withColumns({c: F.lit(1) for c in ("doc", "no", "h1", "line", "n_lines", "parts", "key", "c0", "id", "score")})
    out = linededup.dedup_lines(docs)
    assert out.count() == 5 and set(out.columns) == {*docs.columns, "n_kept"}
    assert simhash.simhash_components(docs).count() == 5 and simhash.keep_one_per_component(docs).columns == docs.columns
    net = langid.fit(["the thing and the other"] * 3 + ["der und die nicht"] * 3, ["en"] * 3 + ["de"] * 3)
    keep = [c for c in docs.columns if c not in ("doc_id", "score")]
    assert langid.identify_language(docs, net, keep=keep).count() == 5
    model = toxicity.fit(["idiot text"] * 8 + ["plain text"] * 8, [1] * 8 + [0] * 8)
    assert toxicity.score_toxicity(docs, model, keep=keep).count() == 5
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (0, [2.0, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0])], "vec_id long, embedding array<double>")
    found = sorted(map(tuple, topk.exact_top_k(vectors).collect()))
    assert [(q, r) for q, r, *_ in found] == [(0, 1), (0, 1), (0, 2), (0, 2)] and {v for _, _, v, _ in found} == {0, 7}
    assert metric_join.near_vectors(vectors).count() == 4 and metric_join.near_vectors(vectors.limit(0)).count() == 0
    for empty in (linededup.dedup_lines(docs.limit(0)), topk.exact_top_k(vectors.limit(0)), langid.identify_language(docs.limit(0), net), toxicity.score_toxicity(docs.limit(0), model)):
        assert empty.count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8)).round(2)
    v[20:30] = v[5] + rng.normal(size=(10, 8)) * 0.1
    v[30:33] = v[7]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(60, None), (61, [0.0] * 8), (62, [float("nan")] * 8), (63, [1.0, None] + [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    low = components(range(64), [tuple(x) for x in np.argwhere(near).tolist()])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.near_vectors(df).collect()}
    assert got == {k: (int(near[k].sum()) if k < 60 else 0, low[k], low[k] == k) for k in range(64)}
    whole = np.floor(v * 256)
    zero = 61  # a zero vector takes part in the search, with score 0
    merged = []
    for q in (0, 50):
        order = sorted([(-int(whole[q] @ whole[k]), k) for k in range(60) if k != q] + [(0, zero)])[:5]
        merged += [(q, r, k, -s) for r, (s, k) in enumerate(order, 1)]
    assert sorted(map(tuple, topk.exact_top_k(df).collect())) == sorted(merged)


def test_vector_lengths_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "PIVOT_SAMPLE", 1)
    rng = np.random.default_rng(6)
    v = []
    for size in (3, 5, 8):
        at = rng.normal(size=(4, size))
        v += [x.tolist() for x in np.concatenate([at, at + rng.normal(size=(4, size)) * 0.02, at[:1]])]
    cosine = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    near = [(a, b) for a, b in itertools.permutations(range(len(v)), 2) if len(v[a]) == len(v[b]) and cosine(v[a], v[b]) >= 0.9]
    low = components(range(len(v)), near)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.near_vectors(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")).collect()}
    assert got == {k: (sum(a == k for a, _ in near), low[k], low[k] == k) for k in range(len(v))}


def test_block_pairs_of_a_crowded_cell_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "BLOCK", 4)
    rows = [(0, True, k, 1, [1.0, k / 100]) for k in range(40)]
    placed = spark.createDataFrame(rows, "cell int, home boolean, fold long, copies long, v array<double>")
    assert metric_join._cell_links(placed, 1, 0.4, 0.9).rdd.getNumPartitions() >= 4


def test_vectors_are_stored_once_whatever_the_cells(spark, monkeypatch):
    """Several cells and blocks: no vector is copied to the cells that it reaches, and no link is lost for it."""
    kept, cut = {}, metric_join.cut
    monkeypatch.setattr(metric_join, "cut", lambda df, label: kept.setdefault(label, cut(df, label)))
    monkeypatch.setattr(metric_join, "VECTORS_PER_PIVOT", 20)
    monkeypatch.setattr(metric_join, "BLOCK", 16)
    rng = np.random.default_rng(11)
    v = rng.normal(size=(150, 12))
    v[:60] = rng.normal(size=(6, 12)).repeat(10, axis=0) + rng.normal(size=(60, 12)) * 0.15  # tight groups, some links of which cross cells
    v[60:80] = v[:20] + rng.normal(size=(20, 12)) * 0.28
    v[80:100] = v[80:100].astype(np.float32)  # packed in single precision
    v[80:85] = v[40:45].astype(np.float32)
    v[100], v[101], v[102] = v[3] * 1e200, v[4] * 1e-200, v[5]
    u = v / np.abs(v).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    low = components(range(len(v)), [tuple(x) for x in np.argwhere(near).tolist()])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.near_vectors(df).collect()}
    assert got == {k: (int(near[k].sum()), low[k], low[k] == k) for k in range(len(v))}
    folds = kept["folds"].count()
    assert folds == len(v) - 1 and kept["cells"].count() == folds and kept["cells"].select("cell").distinct().count() > 2
    assert sum(len(r.folds) // 8 for r in kept["blocks"].collect()) == folds and kept["blocks"].count() > 9


def test_a_cosine_of_the_bound_itself_links(spark):
    """270 / sqrt(900 * 100) is 0.9: vectors scaled to length one first may fall short of it."""
    far = [[9 * k, *x] for k in (1, 3, 7, 2.0**-500) for x in itertools.permutations([3 * k, 3 * k, k])]
    rows = [(0, [30.0, 0.0, 0.0, 0.0]), *((k, [float(c) for c in x]) for k, x in enumerate(far, 1)), (99, [8.999999, 3.0, 3.0, 1.0])]
    got = {r.vec_id: r.n_links for r in metric_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    units = metric_join._unit(np.array([x for _, x in rows]))
    assert got[0] == len(far) and got[99] == len(far)  # the last is near all of them but the first
    assert (units[1:-1] @ units[0] < 0.9).any()


def test_tiles_give_each_pair_once(monkeypatch):
    rng = np.random.default_rng(12)
    a, b = rng.normal(size=(23, 3)).astype(np.float32), rng.normal(size=(19, 3)).astype(np.float32)
    monkeypatch.setattr(metric_join, "TILE", (4, 8))
    for other, same in ((b, False), (a, True)):
        got = [(int(x), int(y)) for i, j, _ in metric_join._hits(a, other, 0.4, same) for x, y in zip(i, j)]
        want = [(x, y) for x, y in np.argwhere(a @ other.T >= 0.4).tolist() if not same or x < y]
        assert sorted(got) == want
    label = np.arange(8)
    metric_join._unite(label, np.array([7, 3, 5, 1]), np.array([3, 2, 7, 1]))
    assert label.tolist() == [0, 1, 2, 2, 4, 2, 6, 2]


def test_bpe_round_trip(spark):
    path = tokenizers_home.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    plain = tiktoken.Encoding("t", pat_str=tokenizers_home.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = [None, "", " ", "a  b \n c\t d", "it's <|endoftext|>", "é漢字🙂" * 40, "=" * 500] + ["".join(rng.choice("abcdeé ß\n1漢🙂- ") for _ in range(80)) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, "en", 0) for k, t in enumerate(texts)], DOCS)
    for r in bpe.encode_documents(docs, path, tokenizers_home.PATTERN).collect():
        t = texts[r.doc_id] or ""
        ids = plain.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_packing(spark):
    from tallyforge.llm.queries import pack

    texts = [None, "", "a", "word " * 1500, "x<|endoftext|>y"] + ["some words here " * k for k in range(1, 60)]
    rows = pack(spark.createDataFrame([(k, t, "en", 0) for k, t in enumerate(texts)], DOCS)).collect()
    slow = packing.byte_bpe_encoder(tokenizers_home.path("byte_bpe_50k.json"))
    for k, t in enumerate(texts):
        pieces = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece)
        assert sum(r.length for r in pieces) == len(slow([t or ""])[0]) + 1 and all(r.length == 1024 for r in pieces[1:])
        assert [r.start for r in pieces] == list(itertools.accumulate([0] + [r.length for r in pieces[:-1]]))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024


def test_warc(spark):
    big = "<p>é" + "x" * 1200
    pages = spark.createDataFrame([(1, "u1", big), (2, None, big), (3, "u\r\n3", "small"), (4, "u", "small"), (5, "u", None)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.warc_round_trip(pages).collect()}
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    n = len(big.encode())
    assert got == {1: ("revisit", 2, n, sha(big)), 2: ("response", None, n, sha(big)), 3: ("response", None, 5, sha("small")), 4: ("response", None, 5, sha("small")), 5: ("response", None, 0, sha(""))}
    raw = warc.record_bytes(1, "u", b"body")
    assert [b for _, b in warc.read_records(io.BytesIO(raw * 2))] == [b"body"] * 2
    import gzip

    for broken in (raw[:-9], gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n"), gzip.compress(b"no record\r\n\r\n")):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(broken)))


def test_html():
    page = "<html><head><title>t</title></head><body><nav><a>menu</a></nav><article><h1>Head&amp;line</h1><p>one <b>two</b>\n three<br>four<p>five<div class='comments'>nice!</div><script>var a='</p>';</script></article><footer>&copy;</footer></body></html>"
    assert html_extract.host_texts([html_extract.page_blocks(page)]) == ["Head&line\none two three four\nfive"]
    menu = " ".join(f"item{k}" for k in range(20))
    pages = [html_extract.page_blocks(f"<body><div>{menu}</div><div>p{k} text of its own, page number {k}, and nothing else</div>") for k in range(4)]
    assert html_extract.host_texts(pages) == [f"p{k} text of its own, page number {k}, and nothing else" for k in range(4)]
    assert html_extract.page_blocks("") == [] and html_extract.host_texts([[]]) == [""]


def test_html_groups_do_not_depend_on_partitions(spark):
    menu = " ".join(f"item{k}" for k in range(20))
    rows = [(k, f"http://h{k % 2}/p{k}", f"<body><div>{menu}</div><div>p{k} text of its own</div><a title=\"open>x</body>") for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = [{r.page_id: r.text for r in html_extract.extract_main_text(pages.repartition(n), group_bytes=900).collect()} for n in (1, 7)]
    assert texts[0] == texts[1] and all(t.startswith("p") or menu in t for t in texts[0].values())
    whole = {r.page_id: r.text for r in html_extract.extract_main_text(pages).collect()}
    assert all(t.startswith(f"p{k} text of its own") for k, t in whole.items())


def test_html_texts_do_not_depend_on_group_sizes(spark):
    menu = " ".join(f"item{k}" for k in range(20))
    rows = [(k, f"http://h{k % 3 % 2}/p{k}", f"<body><div>{menu}</div><div>p{k // 2} text of its own</div></body>" if k % 5 else f"<article><p>{menu} read {k}</p></article>") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = [{r.page_id: (r.text, r.n_chars) for r in html_extract.extract_main_text(pages, group_bytes=n).collect()} for n in (60, 900, 6_000_000)]
    assert texts[0] == texts[1] == texts[2]
    for host in (0, 1):  # as one array over the whole host has it
        of = [k for k in range(40) if k % 3 % 2 == host]
        assert [texts[0][k][0] for k in of] == html_extract.host_texts([html_extract.page_blocks(rows[k][2]) for k in of])


def test_network_is_the_same_in_training_and_use():
    net = langid.ByteCnn(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (40, langid.WINDOW)).astype(np.uint8)
    assert np.abs(net._forward(x)[2] - net.probabilities(x)).max() < 1e-5
    assert net.predict("\u00b2 \u00bd \u2460") == ("und", 0.0)


def test_composed_transducers():
    run = lambda s: "".join(x for x in toxicity.CLAUSES.run(list(s + ".")) if x not in "O.")
    assert run("OIO") == "p" and run("IOT") == "i" and run("TOI") == "i" and run("NOI") == "n" and run("NOOOI") == "p" and run("RTI") == "r"
    assert run("HOT") == "h" and run("NHT") == "" and run("R.I") == "r" and run("RO.I") == "p" and run("HO") == ""


def test_packing_is_best_fit_and_ids_are_exact(spark):
    import zlib

    from tallyforge.llm.queries import pack

    slow = packing.byte_bpe_encoder(tokenizers_home.path("byte_bpe_50k.json"))
    texts = ["some words here " * k for k in (3, 200, 90, 17, 120, 55)] + ["x" * 3000, "a<|endoftext|>b"]
    docs = spark.createDataFrame([(k, t, "en", 0) for k, t in enumerate(texts)], DOCS).coalesce(1)
    for r in pack(docs).collect():
        ids = np.array([*slow([texts[r.doc_id]])[0], 2], "<u4")[r.start : r.start + r.length]
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and len(ids) == r.length
    bins, free = packing.OpenBins(100, 3), []
    rng = random.Random(3)
    for _ in range(400):
        size = rng.randint(1, 60)
        best = min((f for f in free if f >= size), default=100)
        assert bins.place(size)[1] == 100 - best
        if best in free and best < 100:
            free.remove(best)
        if best > size:
            free.append(best - size)
            if len(free) > 3:
                free.remove(min(free))


def test_html_class_words():
    read = lambda page: html_extract.host_texts([html_extract.page_blocks(page)])[0]
    body = '<h2 id="related-work">Related work</h2><h2 id="search">Search</h2><div class="article-header"><h1>Title</h1></div><p>one <a class="share">two</a> <span class="legal">three</span> four</p>'
    text = "Related work\nSearch\nTitle\none two three four"
    assert read(f'<article class="post has-comments">{body}</article>') == text
    assert read(f'<div class="content no-sidebar">{body}</div>') == text
    assert read(f'<article>{body}<div class="ad">x</div><div role="navigation">y</div><section class="wide comments">z</section></article>') == text
    doubt = " ".join(f"share{k}" for k in range(20))
    pages = [html_extract.page_blocks(f'<article><p>p{k} of its own</p><div class="share-buttons">{doubt}</div></article>') for k in range(4)]
    assert html_extract.host_texts(pages) == [f"p{k} of its own" for k in range(4)] and html_extract.host_texts(pages[:1]) == [f"p0 of its own\n{doubt}"]


def test_classifiers():
    rng = random.Random(5)
    clean = [" ".join(rng.choice("the and of house tree water road".split()) for _ in range(40)) for _ in range(200)]
    bad = [" ".join([t, *("idiot" + rng.choice(["en", "ic", "a", "o", "ish", "un"]) for _ in range(2))]) for t in clean[:80]]
    model = toxicity.fit(clean[80:] + bad, [0] * 120 + [1] * 80)
    assert model.score(clean[0] + " idioter idiotisch") >= 0.5 > model.score(clean[0]) and 0 <= model.score(None) < 0.5
    words = {"en": "the and thing with other".split(), "de": "der und nicht schön über".split()}
    texts = [(" ".join(rng.choice(words[x]) for _ in range(60)), x) for x in ("en", "de") for _ in range(80)]
    net = langid.fit([t for t, _ in texts], [x for _, x in texts])
    assert net.predict("the other thing and the thing with the other")[0] == "en" and net.predict("nicht schön und nicht über der")[0] == "de"
    assert net.predict(None) == net.predict(" 12 %%") == ("und", 0.0)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
    kept = corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.001").select(F.count("*").alias("n")).first().n
    assert 0 < kept <= docs.count()
