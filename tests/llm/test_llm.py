"""The operators against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import bpe, chat, cover_tree, exact_dedup, html_text, licenses, mixing, ngram_join, records, toxicity
from tidegrid.llm.common import connected_components

RANKS = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def some_words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every oddity; (rows, frame)."""
    rng = random.Random(3)
    base = some_words(rng, 120)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, base, "b"), (5, base, "b"), (6, base.replace(" ", "  "), "b"), (7, base + " one more word here", "a"), (8, "short one", "a"), (9, "short  ONE", None), (10, some_words(rng, 30_000, 5_000), "c"), (11, "naïve café 日本語 😀 don't \x1c\x85\xa0 x", "c"), (None, "no id", "a"), (12, "row", "a"), (12, "row", "a")]
    return rows, docs(spark, rows)


def brute_components(pairs, ids):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_bpe_equals_the_library(spark, odd):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows, frame = odd
    got = {(r.doc_id, r.n_tokens): r for r in bpe.round_trip(frame, RANKS, P.PATTERN).collect()}
    assert len(bpe.round_trip(frame, RANKS, P.PATTERN).collect()) == len(rows)
    for i, t, _ in rows:
        ids = np.array(e.encode_ordinary(t or ""), "<u4")
        r = got[i, len(ids)]
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoder, tokens = bpe.encoder(RANKS, P.PATTERN)
    rng = random.Random(1)
    alphabet = "ab cde \n\n\t\x1c\x85\xa0'sreve0129²½€é日本😀​́.,!?#-_   "
    for _ in range(1500):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        ids = encoder.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == e.encode_ordinary(x)
        assert bpe.decoded(ids, tokens) == x.encode()
    for x in ("a" * 20_000, " " * 9_000 + "x", "ab" * 9_000 + "\n" * 3_000 + "c\nd e\nf" * 2_000):
        assert np.frombuffer(encoder.encode(x), "<u4").tolist() == e.encode_ordinary(x)


def test_bpe_encode_decode_frames(spark, odd):
    rows, frame = odd
    back = bpe.decode(bpe.encode(frame, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(bytes(r.data) for r in back) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.round_trip(frame.limit(0), RANKS, P.PATTERN).collect() == []


def brute_exact(rows):
    groups = {}
    for k, (i, t, _) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i, k))
    return {min(g, key=lambda x: (x[0], x[1], x[2] or 0, x[3]))[2]: len(g) for g in groups.values()}


def test_exact_dedup(spark, odd):
    rows, frame = odd
    got = exact_dedup.exact_dedup(frame.withColumn("keep_id", F.lit("clash")).withColumn("digest", F.lit(1))).collect()
    want = brute_exact(rows)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(want)
    assert {r.keep_id: r.group_size for r in got} == want
    assert {r.keep_id for r in got if r.doc_id in (4, 5, 6)} == {6}
    kept = exact_dedup.keep_one(frame).collect()
    assert len(kept) == len(want) and kept[0].__fields__ == frame.columns
    assert exact_dedup.exact_dedup(frame.limit(0)).collect() == []


def test_exact_dedup_against_history(spark, odd):
    rows, frame = odd
    old = docs(spark, [(100, "short one", "z"), (101, "unseen", "z")])
    history = exact_dedup.summary(exact_dedup.digests(old))
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame.where("doc_id <> 12"), history).collect()}
    assert not got[8].kept and got[8].keep_id == 100 and got[6].kept and got[4].keep_id == 6


def test_exact_dedup_takes_history_and_new_rows(spark, monkeypatch):
    """Both lots of one corpus hold rows of most groups, some groups lie in one lot, winners lie in either."""
    rng = random.Random(31)
    texts = [some_words(rng, rng.randrange(1, 20)) for _ in range(300)]
    rows = [(k, "".join(rng.choice([" ", "  ", "\n"]) if c == " " else c for c in rng.choice(texts)), "s") for k in range(900)]
    monkeypatch.setattr(exact_dedup, "SHARD", 40)
    monkeypatch.setattr(exact_dedup, "PROBES", 100)
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    want = brute_exact(rows)
    assert len(got) == len(rows) and {r.keep_id: r.group_size for r in got} == want and {r.doc_id for r in got if r.kept} == set(want)
    key = {k: re.sub(r"[\x20\x09-\x0D]", "", t) for k, t, _ in rows}
    assert all(key[r.doc_id] == key[r.keep_id] and r.text_sha256 == hashlib.sha256(key[r.doc_id].encode()).hexdigest() for r in got)


def test_exact_dedup_rejects_a_history_with_repeats(spark):
    history = exact_dedup.summary(exact_dedup.digests(docs(spark, [(1, "a b", "s"), (2, "c", "s")])))
    with pytest.raises(Exception, match="repeats a digest"):
        exact_dedup.exact_dedup(docs(spark, [(3, "ab", "s")]), history.union(history)).collect()


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64)
    h = exact_dedup.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    again = exact_dedup.PerfectHash.load(h.dump())
    assert (again.slots(keys) == h.slots(keys)).all()
    twice = exact_dedup.PerfectHash.build(np.append(keys, keys[:3]))
    assert len(twice.rest) == 6


def test_connected_components_both_ways(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 430)] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    want = {k: v for k, v in brute_components(pairs, range(500)).items() if k in linked}
    for most in (10**6, 0):
        assert {r.id: r.component for r in connected_components(edges, most).collect()} == want
        assert connected_components(edges.limit(0), most).collect() == []


def brute_sets(rows):
    out = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if i is not None:
            out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def jaccard_components(rows):
    sets = brute_sets(rows)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, brute_components(links, ids), len(links)


def near_copies(rng, text, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], ["new" + str(rng.randrange(99))], [w[k], "in"]])
    return " ".join(w)


def check_join(spark, rows):
    got = ngram_join.ngram_jaccard_join(docs(spark, rows)).collect()
    sets, component, n = jaccard_components(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), component[r.doc_id]), r
    return n


def test_ngram_join_oddities(spark, odd):
    check_join(spark, odd[0])
    assert ngram_join.ngram_jaccard_join(odd[1].limit(0)).collect() == []


def test_ngram_join_finds_all_links(spark):
    rng = random.Random(11)
    rows, k = [], 0
    passage = some_words(rng, 55)
    for size in (3, 5, 6, 8, 9, 12, 17, 30, 60, 150, 400):
        for _ in range(4):
            text = some_words(rng, size)
            for share in (0, 0.001, 0.01, 0.02, 0.03, 0.05):
                rows.append((k := k + 1, near_copies(rng, text, share) if share else text, "s"))
    for _ in range(60):  # a passage that many documents share must not link them
        rows.append((k := k + 1, some_words(rng, 200) + " " + passage, "s"))
    base = some_words(rng, 100)
    for _ in range(60):  # a large group of near copies, of which not all are similar to each other
        rows.append((k := k + 1, near_copies(rng, base, 0.02), "s"))
    assert check_join(spark, rows) > 200


def test_allocation_leaves_no_pair_out():
    """Every similar pair shares a signature in a common group, whatever the sizes."""
    rng = np.random.default_rng(2)
    for size in (1, 2, 3, 4, 5, 7, 10, 14, 20, 33, 80, 200):
        for _ in range(30):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            b = a.copy()
            for _ in range(rng.integers(0, size // 3 + 2)):
                kind = rng.integers(3)
                if kind == 0 and len(b) > 1:
                    b = np.delete(b, rng.integers(len(b)))
                elif kind == 1:
                    b = np.append(b, rng.integers(0, 2**63).astype(np.uint64))
                else:
                    b[rng.integers(len(b))] = rng.integers(0, 2**63)
            a, b = np.unique(a), np.unique(b)
            common = len(np.intersect1d(a, b))
            if 100 * common >= 75 * (len(a) + len(b) - common):
                sides = [{int(s) for g in ngram_join.groups(len(x)) for sig, _ in ngram_join.signatures(x, g)[1] for s in sig} for x in (a, b)]
                assert sides[0] & sides[1]


def test_mixing(spark, odd):
    rows, frame = odd
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(frame).collect()))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    weights = {s: w for s, w in zip(sorted(sizes, key=lambda s: (s is None, s or "")), [3, 1, 2, 3], strict=False)}
    target, free = {}, dict(weights)
    rest = 1.5 * sum(sizes.values())
    while True:
        level = rest / sum(free.values())
        over = [s for s in free if level * free[s] > 2 * sizes[s]]
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
            free.pop(s)
        if not over:
            break
    target |= {s: level * w for s, w in free.items()}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
    assert mixing.mix(frame.limit(0)).collect() == []
    assert mixing.repeated(frame).columns == frame.columns


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    rows = [(k, some_words(rng, rng.randrange(1, 60)), rng.choice("aabcdef")) for k in range(3_000)]
    got = mixing.mix(docs(spark, rows)).toPandas()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 60).all()
    taken = mixing.repeated(docs(spark, rows)).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert (got.set_index("doc_id").copies.loc[taken.index] == taken).all()


def test_mixing_repeats_each_row_by_its_own_plan(spark):
    same = [(7, "ten words are in this very text of ours, yes", "a")] * 6
    frame = docs(spark, [*same, (None, "x y", None), (None, "", "a"), (8, "q " * 40, "b"), (9, None, "b")])
    planned = mixing.mix(frame).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect()
    taken = {(r.doc_id, r.source): r["count"] for r in mixing.repeated(frame).groupBy("doc_id", "source").count().collect()}
    assert {(r.doc_id, r.source): r.n for r in planned if r.n} == taken
    assert taken[7, "a"] > 6


def test_records(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    rows, frame = odd
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted(records.token_records(frame, P.path("byte_bpe_50k.json"), P.PATTERN, folder=str(tmp_path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _, _ in rows if i is not None) + [None]
    start, want = 0, {}
    for i, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()))
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, *want[r.doc_id])
        start += r.n_tokens
    assert records.token_records(frame.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN).collect() == []


def test_records_give_added_tokens_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["end <|endoftext|> start", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n\n b", "plain words", "<|endoftext |>", "x " * 6_000 + "<|endoftext|>\n\ny " * 3]
    frame = docs(spark, [(k, x, "a") for k, x in enumerate(texts)])
    got = sorted(records.token_records(frame, P.path("byte_bpe_50k.json"), P.PATTERN, folder=str(tmp_path)).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, x in zip(got, texts, strict=True):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += r.n_tokens
    assert t.token_to_id("<|endoftext|>") in t.encode(texts[0], add_special_tokens=False).ids


def test_records_find_damage_and_shuffle(tmp_path):
    shard = records.Shard(str(tmp_path), "x", 2)
    for k in range(5):
        shard.add(k, np.arange(k + 1))
    shard.close()
    order = np.array([3, 0, 4, 1])
    assert [i for i, _ in records.read_shard(str(tmp_path), "x", order)] == order.tolist()
    path = tmp_path / "x.records"
    data = bytearray(path.read_bytes())
    data[-6] ^= 1
    path.write_bytes(data)
    with pytest.raises(ValueError):
        list(records.read_shard(str(tmp_path), "x"))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body>
<header>Site</header><nav><ul><li><a href=/x>menu</a><li>two</ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>c</p> -->
<article class=post><h1>Head &amp; line</h1><p>First  <b>bold
text</b> &lt;tag&gt;<p>Second<br>line<ul><li>one<li>two</ul><div class="share-box">Share</div><form><input>Send</form>
<aside>See also</aside><table><tr><td>a<td>b<tr><td>c</table><p>Last &copy; {n}</article><section id=comments><p>Reader says</section>
<div class="sidebar">side</div><footer>foot</footer></body></html>"""
TEXT = "Head & line\nFirst bold text <tag>\nSecond line\none\ntwo\na\nb\nc\nLast © {n}"


def test_html_main_text(spark):
    rows = [(k, f"https://a.example/{k}", PAGE.replace("{n}", str(k))) for k in range(8)] + [(8, None, None), (9, "x", ""), (10, "https://b.example", "<p>only</p>text<div>more"), (11, "https://b.example/2", "<article><p>cut &am"), (None, None, "<b>x" * 3000), (7, "https://a.example/7", PAGE.replace("{n}", "7"))]
    got = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("template", F.lit(2))).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for k in range(8):
        assert by[k].text == TEXT.replace("{n}", str(k)) and by[k].n_chars == len(by[k].text)
    assert (by[8].text, by[9].text, by[10].text, by[11].text) == ("", "", "only\ntext\nmore", "cut &am")
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_html_stray_quotes_cut_nothing():
    rest = '</a> and <b class="d">more</b> "text" it\'s<p title=\'q\'>end'
    text = 'A and more "text" it\'s\nend'
    for tag in ('<a href="x"">', '<a href="x" ">', '<a alt="24" monitor">', "<a title=Don't>", '<a href=/s?q=">', '<a href="x" =">', '<a href="x"title="a>b">', '<a title = "a>b">', "<a title='\"'>", '<a b=>', '<a "">', "<a '>"):
        assert html_text.main_text(html_text.parse(tag + "A" + rest)) == text, tag
    assert html_text.main_text(html_text.parse('<p>one <a title="x>two</a> three')) == "one two three"


def test_html_names_of_content_stay():
    page = """<article><h2 id="search-algorithms">Search</h2><section id="related-work"><h2 id="related">Related</h2><p class="legal-text">Law</p><p id="notice">Note</p></section>
<h2 id="form-validation" class="section-header">Forms</h2><p class="ad-hoc">Ad</p><pre><code>x = 1 <span class="hljs-comment"># a</span> <span class="comment"># b</span></code></pre>
<div class="share-box">Share</div><div class="related-posts">Other</div><p class="copyright">C</p><div class="ad-300x250">Buy</div><div class="cookie_notice">Ok</div><div id="site-footer">F</div></article>"""
    assert html_text.main_text(html_text.parse(page)) == "Search\nRelated\nLaw\nNote\nForms\nAd\nx = 1 # a # b"


def test_html_template_is_deleted(spark):
    """A box without telling names that stands on many pages of a host goes; the same text once elsewhere stays."""
    page = "<body><div><span>Join our club today</span></div><div><p>Story number {} of the day</p></div></body>"
    rows = [(k, f"http://h.example/{k}", page.format(k)) for k in range(10)] + [(99, "http://other.example/", page.format(99))]
    got = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story number 3 of the day" and got[99] == "Join our club today\nStory number 99 of the day"


def test_html_template_counts_equal_brute_force(spark):
    """Subtrees by host counted by hand; template removal changes the pages it should, inside articles too."""
    rng = random.Random(13)
    def page(k, host):
        box = f"<div><p>Written by the team of {host}</p><p>More about them</p></div>" if k % 10 else ""
        rare = f"<section><p>Series part of {host}</p></section>" if k % 2 else ""
        return f"<body><div><span>Club of {host}</span></div><article><h1>T {k}</h1>{box}<p>Story {some_words(rng, 8)}</p><p>The same passage for all of us</p>{rare}<div><p>Own {k}</p></div></article></body>"
    rows = [(k, f"http://h{k % 3}.example/{k}", page(k, f"h{k % 3}")) for k in range(60)] + [(100 + k, f"http://few.example/{k}", page(k + 1, "few")) for k in range(4)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    own = frame.withColumns({"host": html_text.host_of(), "page": F.xxhash64("html")})
    got = {(r.host, r.page): (set(r.template), set(r.boxes)) for r in html_text.templates(own).collect()}
    found, pages = {}, {r.page_id: (r.host, r.page) for r in own.collect()}
    for k, _, h in rows:
        found[pages[k]] = html_text.candidates(html_text.hashed(html_text.parse(h)))
    hosts = {}
    for (host, _), subtrees in found.items():
        total, n = hosts.setdefault(host, [0, {}])
        hosts[host][0] = total + 1
        for s in subtrees:
            n[s] = n.get(s, 0) + 1
    for (host, p), subtrees in found.items():
        total, n = hosts[host]
        want = {s for s in subtrees if n[s] >= 5 and n[s] >= 0.2 * total}
        assert got.get((host, p), (set(), set())) == (want, {s for s in want if n[s] >= 0.7 * total})
    texts = {r.page_id: r.text for r in html_text.main_texts(frame).collect()}
    plain = {k: html_text.main_text(html_text.parse(h)) for k, _, h in rows}
    assert {k for k in texts if texts[k] != plain[k]} == {k for k in range(60) if k % 10}
    assert all("The same passage for all of us" in t and ("Written by" in t) == (k > 99) and ("Series part" in t) == (k % 2 == (k < 100)) for k, t in texts.items())


def test_html_every_main_and_articles_that_are_all_box(spark):
    assert html_text.main_text(html_text.parse("<main><p>a</p><main><p>b</p></main></main><p>c</p><main>d</main>")) == "a\nb\nd"
    rows = [(k, f"http://one.example/{k}", f"<nav>{k}</nav><article><div><p>One story on all pages</p></div></article>") for k in range(9)]
    assert {r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"One story on all pages"}


def test_toxicity_learns_and_keeps_clean(spark):
    rng = random.Random(9)
    bad = ["grob", "mean1", "nastyish"]
    rows, labels = [], []
    for k in range(1_500):
        w = some_words(rng, rng.randrange(5, 80), 2_000).split()
        toxic = k % 7 == 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            w.insert(rng.randrange(len(w) + 1), rng.choice([*bad, "vexu" + rng.choice("abcdefghij") * 3]))
        rows.append((k, " ".join(w), "s"))
        if k % 2 == 0:
            labels.append((k, rng.randrange(2), int(toxic)))
    frame = docs(spark, rows + [(5_000, None, "s"), (5_001, "", "s"), (None, "grob", "s")])
    known = spark.createDataFrame([*labels, (3, None, 1), (None, 1, 1), (0, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(frame, known).collect()}
    held = [k for k in range(1_500) if k % 2]
    assert sum(got[k] for k in held if k % 7) == 0
    assert sum(got[k] for k in held if k % 7 == 0) >= 0.95 * sum(k % 7 == 0 for k in held)
    assert not got[5_000] and got[None]
    kept = toxicity.keep_clean(frame, known)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {k for k, t in got.items() if not t}
    assert not any(r.toxic for r in toxicity.toxicity(frame, known.limit(0)).collect())
    assert toxicity.toxicity(frame.limit(0), known).collect() == []


def test_chat_round_trip(spark):
    rng = random.Random(6)
    firsts = ["hello", "hello there", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", ""]
    rows = []
    for c in range(120):
        rows.append((c, 0, "user", rng.choice(firsts)))
        for t in range(1, rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(["assistant", "user", "sys\ntem\\n", None]), rng.choice(["yes", "no <|", "<|<|im_end|>", None, "ü" * 30])))
    rows += [(500, 3, "assistant", "late"), (500, None, "user", "early"), (500, 3, "assistant", "late"), (None, 0, "user", "who")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("clash"))
    got = {r.conv_id: r for r in chat.chat_formatting(chat.with_probe(frame)).collect()}
    rows += [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    own = {}
    for c, t, r, x in rows:
        own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(own)
    for c, turns in own.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == sum(len(chat.formatted(r, x)[0]) for _, _, r, x in turns)
    assert chat.chat_formatting(frame.limit(0)).collect() == []


def test_chat_emits_shared_turns_once():
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    r = chat.packed("r", [("p", [a, b]), ("q", [a, c]), ("s", [a])])
    assert r["text"].count("hi") == 1 and len(r["nodes"]) == 3
    shared = len(chat.formatted(*a)[0])
    assert [n["position"] for n in r["nodes"]] == [0, shared, shared]
    assert [n["ancestors"] for n in r["nodes"]] == [[], [0, shared], [0, shared]]
    assert chat.position_ids(r)[:3] == [0, 1, 2] and len(chat.position_ids(r)) == len(r["text"])


def test_licenses(spark):
    rng = random.Random(8)
    mit = licenses.TEMPLATES["mit-text"]
    rows = [(1, some_words(rng, 5_000) + "\n" + mit + "\n" + some_words(rng, 50), "a"), (2, mit.replace("without restriction", "with no limits at all").replace("Software", "Work", 1), "a"), (3, "Released under the MIT License.", "a"), (4, "Licensed under the Apache License, Version 2.0.", "a"), (5, some_words(rng, 500), "a"), (6, None, "a"), (7, "", "a"), (8, "under the license of many things, released " * 50, "a"), (None, "Released  under the\nMIT LICENSE", "a")]
    got = {(r.doc_id, r.license): r for r in licenses.license_scan(docs(spark, rows)).collect()}
    assert set(got) >= {(1, "mit-text"), (2, "mit-text"), (3, "mit"), (4, "apache-2.0"), (None, "mit")}
    assert {i for i, _ in got} <= {1, 2, 3, 4, None}
    r = got[1, "mit-text"]
    assert r.coverage == 1.0 and (r.first_word, r.end_word) == (5_000, 5_000 + len(licenses.words_of(mit)))
    assert licenses.license_scan(docs(spark, rows).limit(0)).collect() == []


def test_licenses_that_stand_twice(spark):
    rng = random.Random(12)
    apache, mit = licenses.TEMPLATES["apache-2.0-header"], licenses.TEMPLATES["mit"]
    between = lambda n: " " + some_words(rng, n) + " "
    rows = [(1, between(60) + mit + between(7) + mit + between(60), "a"), (2, between(60) + (mit + " ") * 3 + between(60), "a"), (3, between(500) + "".join(apache + between(n) for n in (150, 250, 90)) + between(400), "a"), (4, between(300) + (apache + " ") * 2 + between(300), "a"), (5, between(300) + apache.replace("you may", "you or anyone else may") + between(20) + apache.replace("express or", "") + between(300), "a")]
    got = {(r.doc_id, r.license): r for r in licenses.license_scan(docs(spark, rows)).collect()}
    for i, name, first in ((1, "mit", 60), (2, "mit", 60), (3, "apache-2.0-header", 500), (4, "apache-2.0-header", 300)):
        r = got[i, name]
        assert (r.coverage, r.first_word, r.end_word) == (1.0, first, first + len(licenses.words_of(licenses.TEMPLATES[name])))
    assert got[5, "apache-2.0-header"].coverage == 1.0


def test_licenses_are_told_from_their_kin(spark):
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    told = {
        "This work is licensed under the GNU General Public License, version 2.": {"gpl-2.0"},
        "This work is licensed under the GNU General Public License, version 3.": {"gpl-3.0"},
        "This work is licensed under the GNU General Public License v3.0": {"gpl-3.0"},
        "This work is licensed under the GNU Lesser General Public License, version 3.": {"lgpl-3.0"},
        "This work is licensed under the GNU Affero General Public License, version 3.0.": {"agpl-3.0"},
        gpl.format("General Public License", 2): {"gpl-2.0-header"},
        gpl.format("General Public License", 3): {"gpl-3.0-header"},
        gpl.format("Lesser General Public License", 2.1): {"lgpl-2.1-header"},
        gpl.format("Affero General Public License", 3): {"agpl-3.0-header"},
        "Licensed under the Apache License, Version 1.1": {"apache-1.1"},
        "Licensed under CC BY-SA 3.0": {"cc-by-sa-3.0"},
        "Licensed under CC BY-NC 4.0": {"cc-by-nc-4.0"},
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": {"cc-by-nc-4.0-long"},
        "Released under the BSD License": {"bsd"},
        "Released under the Foo License": set(),
        licenses.TEMPLATES["bsd-2-clause-text"]: {"bsd-2-clause-text"},
        licenses.TEMPLATES["bsd-3-clause-text"]: {"bsd-3-clause-text"},
        licenses.TEMPLATES["mpl-2.0-header"]: {"mpl-2.0-header"},
        licenses.TEMPLATES["apache-2.0-header"]: {"apache-2.0-header"},
        licenses.TEMPLATES["lgpl-3.0"] + " " + licenses.TEMPLATES["gpl-3.0"]: {"lgpl-3.0", "gpl-3.0"},
    }
    told |= {t: {name} for name, t in licenses.TEMPLATES.items()}
    rows = [(k, t, "a") for k, t in enumerate(told)]
    got = {}
    for r in licenses.license_scan(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert {t: got.get(k, set()) for k, t, _ in rows} == told


def test_patience_alignment_is_an_alignment():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghijkl") for _ in range(rng.randrange(30))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert licenses.align(list("abcxyz"), list("abcxyz")) == [(k, k) for k in range(6)]


def test_cover_tree_finds_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(260, 8))
    x[100:160] = x[:60] + rng.normal(size=(60, 8)) * 0.25
    x[200:230] = x[0] + rng.normal(size=(30, 8)) * 0.15
    x[230:240] = x[1]
    x[240:250] *= 1e-170
    monkeypatch.setattr(cover_tree, "BLOCK", 40)
    rows = [(int(k), [float(v) for v in r]) for k, r in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] + [1.0] * 7), (1003, [float("inf")] + [1.0] * 7), (1004, [None] + [1.0] * 7), (1005, []), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("point", F.lit(1)).withColumn("copies", F.lit(2))
    got = {r.vec_id: r for r in cover_tree.near_duplicates(frame).collect()}
    assert len(got) == len(rows)
    u = x / np.abs(x).max(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    component = brute_components([(int(a), int(b)) for a, b in zip(*np.nonzero(close), strict=True)], range(len(x)))
    for k in range(len(x)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (int(close[k].sum()), component[k], component[k] == k)
    for k in range(1000, 1006):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert (got[1006].n_links, got[1007].component_id) == (1, 1006)
    assert cover_tree.near_duplicates(frame.limit(0)).collect() == []


def test_cover_tree_levels_prune():
    """Levels are nested and cover what lies under them, node pairs are pruned above the points, and no pair is lost."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = np.repeat(centres, 30, axis=0) + rng.normal(size=(360, 16)) * 0.05
    x = rng.permutation(x / np.linalg.norm(x, axis=1, keepdims=True))
    a, b = cover_tree.CoverTree(x[:200]), cover_tree.CoverTree(x[200:])
    for t in (a, b):
        assert len(t.sizes) > 3 and t.sizes[0] == 1 and t.sizes[-1] == len(t.points) and (np.diff(t.sizes) > 0).all()
        node = np.arange(len(t.points))
        for k in range(len(t.sizes) - 1, -1, -1):
            node = t.parents[k + 1][node] if k < len(t.sizes) - 1 else node
            away = np.linalg.norm(t.points - t.points[node], axis=1)
            assert (away <= t.radii[k][node] + 1e-7).all() and (t.parents[k][: t.sizes[k - 1]] == np.arange(t.sizes[k - 1])).all() if k else True
    pruned = []
    i, j = cover_tree.close(a, b, float(np.sqrt(0.2)), 0.9, pruned)
    assert set(zip(a.order[i].tolist(), b.order[j].tolist(), strict=True)) == {(p, q) for p, q in zip(*np.nonzero(x[:200] @ x[200:].T >= 0.9), strict=True)}
    assert sum(pruned) > 50
    for n, m in ((1, 1), (1, 40), (40, 1), (2, 7)):
        a, b = cover_tree.CoverTree(x[:n]), cover_tree.CoverTree(x[300 : 300 + m])
        i, j = cover_tree.close(a, b, float(np.sqrt(0.2)), 0.9)
        assert set(zip(a.order[i].tolist(), b.order[j].tolist(), strict=True)) == {(p, q) for p, q in zip(*np.nonzero(x[:n] @ x[300 : 300 + m].T >= 0.9), strict=True)}


def test_cover_tree_rows_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 0.05]), (3, [1.0, 0.05]), (0, [-1.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False)]


CLASHES = ("own_id", "_copies", "copies", "gone", "row", "Row", "w_id", "w_sha", "sha", "s", "edge", "range", "size", "h", "whole", "keep_id", "component_id", "p_toxic", "_p", "key", "sig", "doc", "uid", "a", "id")


def clashing(frame):
    return frame.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES) if c != "Row"})


def test_stages_take_odd_rows_clashing_names_and_empty_tables(spark, odd):
    rows, frame = odd
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (8, 1, 0), (11, 1, 0)], "doc_id long, quality int, toxic int")
    wide = clashing(frame)
    stages = {"toxicity": lambda d: toxicity.keep_clean(d, labels), "exact": exact_dedup.keep_one, "ngram": ngram_join.keep_one, "mixing": mixing.repeated}
    for name, stage in stages.items():
        out = stage(wide)
        assert out.columns == wide.columns, name
        plain = sorted(str((r.doc_id, r.text, r.source)) for r in stage(frame).collect())
        got = out.collect()
        assert sorted(str((r.doc_id, r.text, r.source)) for r in got) == plain and all(r.gone == CLASHES.index("gone") for r in got), name
        assert stage(wide.limit(0)).collect() == [] and stage(wide.limit(0)).columns == wide.columns, name
    _, component, _ = jaccard_components(rows)
    kept = [r.doc_id for r in ngram_join.keep_one(frame).collect()]
    assert sorted(i for i in kept if i is not None) == sorted(i for i, _, _ in rows if i is not None and component[i] == i) and kept.count(None) == 1


def test_queries_take_clashing_names(spark, odd):
    """Further columns change nothing, whatever their names."""
    _, frame = odd
    few = frame.where("doc_id is null or doc_id <> 10")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    for run in (lambda d: bpe.round_trip(d, RANKS, P.PATTERN), lambda d: records.token_records(d, P.path("byte_bpe_50k.json"), P.PATTERN), mixing.mix, lambda d: toxicity.toxicity(d, labels.withColumn("keys", F.lit(1))), licenses.license_scan, ngram_join.ngram_jaccard_join):
        assert sorted(map(str, run(clashing(few)).collect())) == sorted(map(str, run(few).collect()))


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    now = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf)
        assert after.columns == source.columns, name
        rows = [(r.doc_id, r.text, r.source) for r in now.collect()]
        got = [r.doc_id for r in after.collect()]
        if name == "exact_dedup":
            assert sorted(got) == sorted(brute_exact(rows))
        if name == "ngram_join":
            _, component, _ = jaccard_components(rows)
            assert sorted(got) == sorted(set(component.values()))
        now = spark.createDataFrame(after.collect(), source.schema)
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert sorted(out.doc_id) == sorted(r.doc_id for r in now.select("doc_id").collect())
    assert len(pd.unique(out.ids_sha256)) > 10


def test_workers_let_go_of_encoders(spark, odd):
    """A worker process that waits for its next task holds no vocabulary and no table of words."""
    bpe.round_trip(odd[1], RANKS, P.PATTERN).collect()
    bpe.decode(bpe.encode(odd[1], RANKS, P.PATTERN), RANKS, P.PATTERN).collect()

    def held(batches):
        for b in batches:
            yield pd.DataFrame({"n": [bpe.encoder.cache_info().currsize] * len(b)})

    assert {r.n for r in spark.range(0, 32, 1, 16).mapInPandas(held, "n int").collect()} == {0}


def test_each_stage_makes_the_session_ready(spark, odd, monkeypatch):
    """A stage that is run without run() bounds its batches, and its workers give memory back."""
    import corpus_pipeline
    from tidegrid import workers

    environment, before = spark.sparkContext.environment, spark.conf.get(workers.BATCH)
    for name in workers.MEMORY:
        monkeypatch.delenv(name, raising=False)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(workers.BATCH)
            for k in workers.MEMORY:
                monkeypatch.delitem(environment, k, raising=False)
            stage(spark, odd[1].where("doc_id > 3"), "/root/testdata/sf0.001")
            assert spark.conf.get(workers.BATCH) == "4m", name
            assert workers.MEMORY.items() <= environment.items(), name
    finally:
        spark.conf.set(workers.BATCH, before)
