"""Alignment, vector codes and token counts against the libraries and brute force, with every oddity of rows."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from tidegrid.llm import align, token_counts, vector_codes

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
rng = random.Random(5)
LETTERS = "ab cde \n\n\t\x1c\x85\xa0'sreve0129²½€é日本😀​́.,!?#-_   ▁"
TEXTS = [None, "", " ", " lead", "<|endoftext|> </s> <0x41>", "a<|endoftext|> b" * 300, " ".join(f"w{rng.randrange(9999)}" for _ in range(9_000)), "x" * 9_000, "y" * 3_000 + " " + "z" * 30_000 + " <|endoftext|>" + "q " * 5_000]
TEXTS += ["".join(rng.choice(LETTERS if n % 2 else LETTERS[:-1]) for _ in range(n)) for n in (300, 5_000, 901, 200, 3_300, 20, 31, 40, 50, 61, 70)]
TEXTS += [TEXTS[6], TEXTS[10], TEXTS[10]]
#: doc_id null for some, repeated for others.
ROWS = [(None if i % 5 == 0 else i // 2, t) for i, t in enumerate(TEXTS)]
CLASHES = "doc_id long, text string, uid long, start long, digest string, k long, `a.b` string, n_bytes long, pair long, label string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7, None, "x", 1, "y", None, 2, None) for i, t in ROWS], CLASHES).repartition(3)


def alignment(rows):
    """By the libraries, a token at a time: per document ids of both, links and groups."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    byte = {chr(letter): b for b, letter in align.LETTERS.items()}
    out = []
    for doc_id, text in rows:
        ids, spans = ([], []), ([], [])
        if text:
            ids = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            tokens = [bytes(map(byte.__getitem__, t.id_to_token(i))) for i in ids[0]], [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
            if any(b"".join(x) != (" " + text).encode() for x in tokens):
                ids = [], []
            else:
                spans = [[(sum(map(len, x[:k])), sum(map(len, x[: k + 1]))) for k in range(len(x))] if len(x) < 500 else _spans(x) for x in tokens]
        links, j = [], 0
        for i, (start, end) in zip(ids[0], spans[0], strict=True):
            while spans[1][j][1] <= start:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < end:
                links.append((i, ids[1][k]))
                k += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = defaultdict(lambda: ([], []))
        for side in (0, 1):
            for i, (_, end) in zip(ids[side], spans[side], strict=True):
                groups[bisect.bisect_left(cuts, end)][side].append(i)
        out.append((doc_id, ids, links, [groups[k] for k in sorted(groups)]))
    return out


def _spans(tokens):
    at, out = 0, []
    for x in tokens:
        out.append((at, at + len(x)))
        at += len(x)
    return out


def digests(found):
    docs = Counter(p for *_, links, _ in found for p in set(links))
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(best.get(a, 0), n)
    for doc_id, ids, links, groups in found:
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sha = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        yield doc_id, len(ids[0]), len(ids[1]), len(groups), len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links), sha


@pytest.fixture(scope="module")
def found():
    return alignment(ROWS)


@pytest.mark.parametrize("window", [align.WINDOW, 3_000, 10])
def test_alignment_equals_brute_force(docs, found, window):
    got = align.aligned(docs, A, B, P.PATTERN, window=window)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(digests(found))
    assert sum(not ids[0] for _, ids, *_ in found) > 2  # null, empty, a text that holds the piece for a space


def test_alignment_joins_by_shuffle_too(docs, found, monkeypatch):
    monkeypatch.setattr(align, "BROADCAST_PAIRS", -1)
    assert Counter(map(tuple, align.aligned(docs, A, B, P.PATTERN).collect())) == Counter(digests(found))


def test_groups_are_whole(spark, found):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in align.groups(frame, A, B, P.PATTERN, window=100).orderBy("doc_id", "part").collect():
        assert r.part == len(got[r.doc_id])
        got[r.doc_id].append((r.a_ids, r.b_ids))
    assert [got.get(i, []) for i in range(len(TEXTS))] == [g for *_, g in found]


def test_long_texts_come_in_several_runs(spark, monkeypatch):
    text = " ".join(f"{i:x}é" for i in range(40_000))
    frame = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    events = align.end_events(frame, A, B, P.PATTERN).where("doc_id = 1")
    assert events.groupBy("side").count().toPandas()["count"].min() > 3
    assert Counter(map(tuple, align.aligned(frame, A, B, P.PATTERN, window=5_000).collect())) == Counter(digests(alignment([(1, text), (2, "short")])))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.aligned(none, A, B, P.PATTERN).collect() == [] and token_counts.token_counts(none, A).collect() == []
    assert align.groups(none, A, B, P.PATTERN).collect() == []
    assert vector_codes.vector_codes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("chunk,overlap", [(token_counts.CHUNK, token_counts.OVERLAP), (500, 40), (3_000, 8)])
def test_counts_equal_the_library(docs, name, chunk, overlap):
    tokens = token_counts.tokens_of(P.path(name))
    assert tokens.proven
    want = Counter((i, len((t or "").encode()), n := tokens.counts([t or ""])[0], n > 1024) for i, t in ROWS)
    assert Counter(map(tuple, token_counts.token_counts(docs, P.path(name), chunk=chunk, overlap=overlap).collect())) == want


def test_overlaps_widen_until_chunks_align(spark):
    """A stretch without a space fails at first, and a text without any ends as one chunk."""
    texts = {"a": "word " * 500 + "x" * 2_000 + " word" * 500, "b": "ab" * 5_000, "c": "one two " * 700}
    frame = spark.createDataFrame(list(texts.items()), "digest string, text string")
    first = token_counts.spliced(token_counts.joints(token_counts.chunked(frame, 400, 50).repartition("digest", "k"), A, 400, 50)).collect()
    assert {r.digest: r.failed for r in first} == {"a": True, "b": True, "c": False}
    tokens = token_counts.tokens_of(A)
    assert {r.digest: r.n_tokens for r in token_counts.huge_counts(frame, A, 400, 50).collect()} == {k: tokens.counts([t])[0] for k, t in texts.items()}


def test_a_tokenizer_without_proof_takes_texts_whole(spark, tmp_path):
    import json

    with open(A, encoding="utf-8") as f:
        j = json.load(f)
    j["pre_tokenizer"]["use_regex"] = False
    path = str(tmp_path / "open.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(j, f)
    text = "some words here " * 50
    tokens = token_counts.tokens_of(path)
    assert not tokens.proven
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.n_tokens for r in token_counts.token_counts(frame, path, chunk=100, overlap=20).collect()] == tokens.counts([text])
    with pytest.raises(ValueError, match="proven"):
        token_counts.huge_counts(frame, path)


def test_the_library_is_asked_for_each_piece_once():
    """Of whole texts and of chunks, which were encoded anew from end to end."""
    tokens, asked = token_counts.JsonTokens(A), Counter()
    whole, ends = tokens.counts, token_counts.Ends(token_counts.JsonTokens(A)).before
    own = tokens.tokenize
    tokens.tokenize = lambda piece: asked.update([piece]) or own(piece)
    tokens.counts = tokens.ends = None
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))) + rng.choice(["", ",", ".\nNext", "###"]) for _ in range(300)]
    texts, spans = [" ".join(rng.choices(words, k=2_000)) for _ in range(4)], [(0, 200), (3_000, 3_200)]
    counter = token_counts.PieceCounts(tokens)
    assert counter.counts(texts) == whole(texts)
    assert [counter.before(t, spans) for t in texts] == [ends(t, spans) for t in texts]
    assert set(asked.values()) == {1} and len(asked) < 1_000


def test_pieces_of_odd_texts_equal_the_library():
    tokens = token_counts.JsonTokens(A)
    counter, own = token_counts.PieceCounts(tokens), random.Random(8)
    odd = [*LETTERS, *"\x1f\u0250\u1680\u180e\u2028\u3000ªʰǅ\r\0", "<|endoftext|>", "\n <|endoftext|>", " a b", "it's 12"]
    for k in range(3_000):
        text = "".join(own.choices(odd if k % 2 else "ab é.\n", k=k % 40))
        assert counter.count(text) == tokens.counts([text])[0] and counter.count(text, True) == tokens.counts([" " + text])[0]
        spans = [(0, k % 20), (k % 7, 30)]
        assert counter.before(text, spans) == token_counts.Ends(tokens).before(text, spans)


def test_only_plain_byte_level_files_go_by_pieces(tmp_path):
    """Added tokens of letters, a prefix space, and files that split or normalize in other ways."""
    import json

    with open(A, encoding="utf-8") as f:
        j = json.load(f)
    letters = j["added_tokens"][0] | {"id": 50257, "content": "ab", "special": False}
    changes = {"letters": {"added_tokens": [*j["added_tokens"], letters]}, "prefix": {"pre_tokenizer": j["pre_tokenizer"] | {"add_prefix_space": True}}, "lower": {"normalizer": {"type": "Lowercase"}}}
    for name, change in changes.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(j | change), encoding="utf-8")
        tokens = token_counts.JsonTokens(str(path))
        assert tokens.proven and tokens.level == (name == "letters")
        texts = ["cab Abc ab\nab  xab,", "Ab", "a b\n ab"]
        assert token_counts.counter_of(tokens).counts(texts) == tokens.counts(texts)
    assert not any(token_counts.tokens_of(P.path(n)).level for n in ("word_bpe_49k.json", "piece_bpe_32k.model"))


def codes(vectors, parts, entries, rounds):
    """One component at a time, in Python integers: codebooks, and (code, error) of each vector."""
    q = [[int(np.floor(4096 * float(x))) for x in v] for v in vectors]
    w = len(q[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in q]
    books = [[cut[i][p] for i in range(min(entries, len(q)))] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in cut:
                own[best(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    found = [[best(v[p], books[p]) for p in range(parts)] for v in cut]
    return books, [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in found]


@pytest.mark.parametrize("n,spread", [(300, 0.5), (9, 0.5), (60, 1e-3), (200, 40.0)])
def test_codes_equal_brute_force(spark, n, spread):
    """Spread-out vectors, fewer vectors than entries, vectors of many equal distances, components beyond single precision's integers."""
    r = np.random.default_rng(n)
    x = r.normal(0, spread, (n, 16)).astype(np.float32)
    x[n // 2] = x[0]
    labels = [None if k % 4 == 0 else k % 3 for k in range(n)]
    rows = [(k, v, l, 1) for k, (v, l) in enumerate(zip(x.tolist(), labels, strict=True))]
    odd = [(1000, None, 1, 1), (1001, [1.0] * 15 + [float("nan")], 1, 1), (1002, [1.0] * 15 + [float("inf")], None, 1), (-5, [1.0] * 15 + [None], 1, 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, own_label int").repartition(5)
    books, want = codes(x, 8, 16, 6)
    got = {g.vec_id: g for g in vector_codes.vector_codes(frame).collect()}
    assert {k: (g.code, g.error) for k, g in got.items()} == dict(enumerate(want))
    sums = Counter()
    for (_, e), label in zip(want, labels, strict=True):
        sums[label] += e
    assert all(got[k].label_error == sums[label] for k, label in enumerate(labels))
    text = ",".join(str(c) for b in books for e in b for c in e)
    assert {g.codebooks_sha256 for g in got.values()} == {hashlib.sha256(text.encode()).hexdigest()}


def test_nearest_looks_twice_where_single_precision_cannot_tell():
    r = np.random.default_rng(2)
    e = r.integers(-(1 << 24), 1 << 24, (16, 8))
    e[7] = e[3]
    x = np.concatenate((e[[3, 7, 9]], (e[2] + e[5])[None] // 2, r.integers(-(1 << 25), 1 << 25, (4_000, 8))))
    near = e[0] + r.integers(-2, 3, (16, 8))  # entries that single precision can't tell apart
    for book in (e, near):
        best, distance, again = vector_codes.nearest(x, book)
        exact = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (best == exact.argmin(1)).all() and (distance == exact.min(1)).all() and again > 1
    assert vector_codes.nearest(x, e)[2] < 0.3 * x.shape[0] and vector_codes.nearest(x, e)[0][1] == 3


def test_null_ids_repeated_rows_and_errors(spark):
    schema = "vec_id long, embedding array<double>, label string"
    rows = [(None, [float(k)] * 8, "l") for k in range(3)] + [(5, [9.0] * 8, "l")] * 2
    got = vector_codes.vector_codes(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and len({(g.vec_id, g.code) for g in got}) == 4 and {g.label_error for g in got} == {0}
    for bad in ([(1, [1.0] * 8, "l"), (2, [1.0] * 16, "l")], [(1, [1.0] * 7, "l")], [(1, [1e30] * 8, "l")]):
        with pytest.raises(Exception, match="length|large"):
            vector_codes.vector_codes(spark.createDataFrame(bad, schema)).collect()


def test_licenses_at_the_threshold(spark):
    """Each template with exactly the allowed words replaced, none of them a required one: what the alignment of the text and template finds, the scan does too."""
    from tidegrid.llm import licenses

    r, rows, want = random.Random(11), [], {}
    for name, template in licenses.TEMPLATES.items():
        words, needed = licenses.words_of(template), set(licenses.words_of(licenses.REQUIRED.get(name, "")))
        allowed = len(words) - licenses.least_of(words)
        assert 100 * (len(words) - allowed) >= 80 * len(words) > 100 * (len(words) - allowed - 1)
        free = [i for i, w in enumerate(words) if w not in needed]
        for _ in range(4):
            own = list(words)
            for i in r.sample(free, min(allowed, len(free))):
                own[i] = f"zz{r.randrange(10**6)}"
            pairs = licenses.align(own, words)
            if 100 * len(pairs) >= 80 * len(words) and needed <= {words[j] for _, j in pairs}:
                want[len(rows)] = len(pairs)
            rows.append((len(rows), " ".join(own)))
    got = {}
    for g in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[g.doc_id] = max(got.get(g.doc_id, 0), round(g.coverage * len(licenses.words_of(licenses.TEMPLATES[g.license]))))
    assert len(want) > 0.95 * len(rows)
    assert not [i for i, n in want.items() if got.get(i, 0) < n]
    one = spark.createDataFrame([(1, "Licensed under the MIT license.")], "doc_id long, text string")
    assert [(g.license, g.coverage) for g in licenses.license_scan(one).collect()] == [("mit", 0.8)]
    with pytest.raises(ValueError, match="coverage"):
        licenses.license_scan(one, coverage=0.5)


def test_exact_dedup_keeps_columns_of_any_name(spark):
    from tidegrid.llm import exact_dedup

    rows = [(1, "a b", 1, "x"), (1, "ab", 2, "y"), (2, "c", 3, None), (1, "d", 4, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, `c``d` string")
    got = exact_dedup.keep_one(frame)
    assert got.columns == frame.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[3], rows[2]]


def test_large_prefix_trees_repeat_only_the_turns_above_a_split(spark):
    """2,400 conversations with one first turn and eight second ones; two more levels under one of them; equal and short ones."""
    from tidegrid.llm import chat

    says = lambda i: [("user", "hello"), ("assistant", f"second {i % 8}"), *([("user", f"third {i % 3}"), ("assistant", f"x{i}")] if i % 8 == 0 else [("user", f"y{i}")])]
    talks = {i: says(i) for i in range(2_400)} | {5_000: [("user", "hello")], 5_001: [("user", "hello")], 5_002: [("user", "alone")], 5_003: says(7)}
    rows = [(i, t, r, x) for i, turns in talks.items() for t, (r, x) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    paths = chat.conversation_paths(frame)
    for most in (1_000, 120, 3):
        records = chat.prefix_trees(paths, most).collect()
        shown = [chat.START + t for r in records for t in r.text.split(chat.START)[1:]]
        count = Counter(t for t in shown if "second" in t or "third" in t)
        if most == 1_000:
            assert count[chat.formatted("assistant", "second 0")[0]] == 1 and set(count.values()) == {1} and len(count) == 11
            assert shown.count(chat.formatted("user", "hello")[0]) == len([r for r in records if "hello" in r.text]) <= 4
        assert sum(len(r.leaves) for r in records) == len({tuple(x) for x in talks.values()})
        assert max(len(r.leaves) for r in records) <= 4 * most
    got = {r.conv_id: r for r in chat.chat_formatting(frame).collect()}
    assert got.keys() == talks.keys()
    for i, turns in talks.items():
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
