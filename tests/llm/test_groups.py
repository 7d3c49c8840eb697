"""Operators over many rows against brute force: joins, repeats, lines, packing, search, dialogues, the pipeline."""

import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import documents, rows_by_id
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SMALL
from oracle import compare, duck
from poolsift.llm import dialogue, line_dedup, ngram_join, packing, queries, suffix_dedup, topk
from poolsift.llm.common import table
from poolsift.llm.components import components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def words(rng, count, vocabulary=500):
    return [f"w{n}" for n in rng.integers(0, vocabulary, count)]


# ---------------------------------------------------------------- components


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)}


# ---------------------------------------------------------------- n-gram join


def gram_set(text):
    found = (text or "").split()
    if len(found) < 5:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def brute_groups(texts):
    sets = [gram_set(t) for t in texts]
    links = [[] for _ in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a == b or (a or b) and len(a & b) >= 0.8 * len(a | b):
            links[i].append(j)
            links[j].append(i)
    group = list(range(len(texts)))
    for _ in texts:
        group = [min([group[i], *(group[j] for j in links[i])]) for i in range(len(texts))]
    return [len(x) for x in links], group


@pytest.fixture(scope="module")
def near_texts():
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(12):
        base = words(rng, int(rng.integers(20, 200)))
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 5))):
                copy[int(rng.integers(len(copy)))] = "edit" + str(rng.integers(9))
            texts.append(" ".join(copy))
    return texts + [texts[0], "  " + texts[0] + "\n", "a b", "a  b", "", None, "one"]


def test_links_and_groups_agree_with_all_pairs(spark, near_texts):
    links, group = brute_groups(near_texts)
    for chunk in (1024, 3):
        got = rows_by_id(ngram_join.jaccard_groups(documents(spark, near_texts).selectExpr("*", "1 AS bands"), chunk_texts=chunk))
        assert [got[i].n_links for i in range(len(near_texts))] == links
        assert [got[i].group_id for i in range(len(near_texts))] == group


def test_a_long_chain_over_two_chunks_is_one_group(spark):
    rng = np.random.default_rng(3)
    tape = words(rng, 132)
    texts = [" ".join(tape[i : i + 13]) for i in range(120)]  # neighbours share 8 of 10 n-grams
    links, group = brute_groups(texts)
    assert group == [0] * 120
    got = rows_by_id(ngram_join.jaccard_groups(documents(spark, texts), chunk_texts=60))
    assert [got[i].n_links for i in range(120)] == links
    assert [got[i].group_id for i in range(120)] == group


@given(st.integers(0, 6), st.integers(1, 6), st.integers(0, 2**32))
def test_parts_of_two_chunks_are_connected(one, two, seed):
    rng = np.random.default_rng(seed)
    names = rng.permutation(one + two).astype(np.int64)
    sets = [np.unique(rng.integers(0, 4, 3)).astype(np.uint64) for _ in names]
    counts, least = ngram_join.block_links(names, np.ones(len(names), np.int64), sets, one, 0.5)
    label = names.copy()
    degree = [0] * len(names)
    for _ in names:
        for i, j in itertools.product(range(one), range(one, one + two)):
            common = len(np.intersect1d(sets[i], sets[j]))
            if common >= 0.5 * len(np.union1d(sets[i], sets[j])):
                label[i] = label[j] = min(label[i], label[j])
    for i, j in itertools.product(range(one), range(one, one + two)):
        if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j])):
            degree[i] += 1
            degree[j] += 1
    assert least.tolist() == label.tolist() and counts.tolist() == degree


def test_one_row_of_each_group_stays(spark, near_texts):
    docs = documents(spark, near_texts)
    kept = ngram_join.keep_one_of_each_group(docs.union(docs).selectExpr("*", "'x' AS size")).collect()
    _, group = brute_groups(near_texts)
    assert sorted(group[r.doc_id] for r in kept) == sorted(set(group))
    assert kept[0].size == "x"


def test_recall_of_the_bands():
    bands, rows = ngram_join.band_shape()
    assert 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL and bands * rows <= ngram_join.MOST_HASHES


# ---------------------------------------------------------------- repeated bytes


def brute_repeats(texts, length):
    seen = {}
    for t in texts:
        body = (t or "").encode()
        for i in range(len(body) - length + 1):
            seen[body[i : i + length]] = seen.get(body[i : i + length], 0) + 1
    out = []
    for t in texts:
        body = (t or "").encode()
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - length + 1):
            if seen[body[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
        out.append((len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_agree_with_all_windows(spark):
    rng = np.random.default_rng(2)
    common = " ".join(words(rng, 90))
    texts = [
        "a" * 1000, "ab" * 700, "b" + "a" * 450, "x" * 199, "", None, "é" * 150, "é" * 100 + "z" + "é" * 100,
        "q" * 200, "q" * 200, "abc" * 300 + "Z" + "abc" * 90,
    ]
    for i in range(30):
        cut = int(rng.integers(0, 200))
        texts.append(" ".join(words(rng, 30)) + common[cut : cut + 150 + 10 * i] + " ".join(words(rng, 40)))
    want = brute_repeats(texts, 200)
    docs = documents(spark, texts).selectExpr("*", "1 AS key", "2 AS hash", "'d' AS doc")
    for most in (suffix_dedup.MOST_STRETCHES, 1):
        found = suffix_dedup.without_repeats(docs, most_stretches=most)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found.collect()}
        assert [got[i] for i in range(len(texts))] == want
    rows = suffix_dedup.repeats_report(documents(spark, ["z" * 10]).union(documents(spark, ["y" * 300])).union(documents(spark, ["y" * 300]))).collect()
    assert sorted(r.n_removed for r in rows) == [0, 300, 300]
    assert suffix_dedup.repeats_report(documents(spark, [])).count() == 0


def test_places_where_no_window_begins_are_not_sorted(monkeypatch):
    rng = np.random.default_rng(4)
    shared = rng.integers(2, 90, 260).astype(np.uint8)
    bodies = [np.concatenate([rng.integers(2, 90, int(rng.integers(0, 60))).astype(np.uint8), shared[: 200 + i]]) for i in range(40)]
    data = np.concatenate([part for body in bodies for part in (body, np.zeros(1, np.uint8))])
    directly, sort = [], suffix_dedup._sort_directly
    monkeypatch.setattr(suffix_dedup, "_sort_directly", lambda data, places, depth: directly.append(len(places)) or sort(data, places, depth))
    flags = suffix_dedup.repeated_windows(data, 200)
    windows = [data[i : i + 200].tobytes() for i in range(len(data) - 199)]
    times = Counter(w for w in windows if b"\0" not in w)
    assert np.flatnonzero(flags).tolist() == [i for i, w in enumerate(windows) if times[w] > 1]
    begins = sum(len(body) - 199 for body in bodies)
    assert directly[0] <= begins + len(bodies) < len(data) / 3



@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(1 + x % 3 for x in b)), max_size=6))
def test_suffix_array_is_sorted(bodies):
    data = np.frombuffer(b"".join(b + b"\0" for b in bodies), np.uint8)
    raw = data.tobytes()
    order = suffix_dedup.suffix_array(data, 64).tolist()
    assert sorted(order) == list(range(len(raw)))
    assert [raw[i : i + 64] for i in order] == sorted(raw[i : i + 64] for i in order)
    flags = suffix_dedup.repeated_windows(data, 9)
    windows = [raw[i : i + 9] for i in range(len(raw))]
    assert flags.tolist() == [len(w) == 9 and b"\0" not in w and windows.count(w) > 1 for w in windows]


# ---------------------------------------------------------------- lines


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_patience_aligns_equal_lines_in_order(a, b):
    found = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
    if a == b:
        assert len(found) == len(a)


def test_copied_blocks_go_from_the_later_document(spark):
    line = [f"this is line number {i} of the corpus" for i in range(40)]
    texts = [
        "\n".join(line[:10]),
        "\n".join(["a new beginning of this document here", *line[2:6], "short", "the end of it is new too"]),
        "\n".join(line[:10]),
        "",
        None,
        "short\nshort\nshort",
        "short\nother",
        "\n".join(["only the first line is the same as", line[0]]),
    ]
    got = rows_by_id(line_dedup.line_report(documents(spark, texts).selectExpr("*", "'x' AS _mask")))
    assert [got[i].n_removed for i in range(8)] == [0, 4, 10, 0, 0, 0, 0, 1]
    assert [got[i].n_lines for i in range(8)] == [10, 7, 10, 0, 0, 3, 2, 2]
    kept = "\n".join(["a new beginning of this document here", "short", "the end of it is new too"])
    assert got[1].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert got[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    left = line_dedup.drop_copied_lines(documents(spark, texts).selectExpr("*", "'x' AS _mask"))
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 3, 4, 5, 6, 7] and left.columns == ["doc_id", "text", "_mask"]


def test_a_line_goes_from_all_later_documents_however_many_hold_it(spark):
    notice = "all rights reserved by the owners of this text"
    texts = [f"{notice}\nnothing else in document {i} is like the others" for i in range(105)]
    got = rows_by_id(line_dedup.line_report(documents(spark, texts)))
    assert [got[i].n_removed for i in range(105)] == [0] + [1] * 104
    assert line_dedup.line_report(documents(spark, [])).count() == 0


def plain_patience(a, b):
    """Aligned places of two lists, by tables: equal ends, then a longest run of lines unique in both, then what lies between."""
    found = []
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        found.append((start, start))
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
        found.append((len(a) - end, len(b) - end))
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    unique = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 == b.count(x)]
    if unique:
        size = []
        for k, (_, j) in enumerate(unique):
            size.append(1 + max([size[m] for m in range(k) if unique[m][1] < j], default=0))
        chain, want = [], max(size)
        for k in range(len(unique) - 1, -1, -1):
            if size[k] == want and (not chain or unique[k][1] < chain[-1][1]):
                chain.append(unique[k])
                want -= 1
        inner, at = [], (0, 0)
        for i, j in [*chain[::-1], (len(a), len(b))]:
            inner += [(at[0] + x, at[1] + y) for x, y in plain_patience(a[at[0] : i], b[at[1] : j])]
            inner += [(i, j)] if i < len(a) else []
            at = (i + 1, j + 1)
    else:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        inner, i, j = [], len(a), len(b)
        while i and j:
            if best[i][j] == best[i][j - 1]:
                j -= 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                i, j = i - 1, j - 1
                inner.append((i, j))
    return found + [(start + i, start + j) for i, j in inner]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=12), st.lists(st.integers(0, 6), max_size=12))
def test_patience_agrees_with_tables(a, b):
    assert line_dedup.patience(a, b) == sorted(plain_patience(a, b))


def _copied(texts):
    """Lines that go from each text, and the pairs aligned for it (all lines of five words): first holders, then those that hold an
    open line as often, besides the first that holds it half, a quarter, ... as often."""
    lines = [t.split("\n") for t in texts]
    gone, pairs = [], 0
    for d, own in enumerate(lines):
        before = lines[:d]
        partners = {min(g for g in range(d) if x in before[g]) for x in own if any(x in b for b in before)}
        last = {x: min(g for g in range(d) if x in before[g]) for x in own if any(x in b for b in before)}
        removed, most, first = set(), 1, True
        while partners:
            pairs += len(partners)
            removed |= {j for g in partners for _, j in plain_patience(before[g], own)}
            still = {x for j, x in enumerate(own) if j not in removed and x in last}
            last = {x: last[x] for x in still}
            partners, ahead = set(), {}
            for x, tried in last.items():
                c = own.count(x)
                needs = {-(-c // 2**i) for i in range(c.bit_length())} if first else {c}
                for need in needs:
                    if need > 1 or c == 1:
                        near = [g for g, other in enumerate(lines) if g > tried and other.count(x) >= need][:most]
                        partners |= {g for g in near if g < d}
                        if need == c and len(near) == most and near[-1] < d:
                            ahead[x] = near[-1]
            last, most, first = ahead, min(most * line_dedup.FASTER, line_dedup.MOST), False
        gone.append(len(removed))
    return gone, pairs


def test_open_lines_are_aligned_with_further_documents(spark):
    line = {c: f"this line of text has {c}" for c in "xyzpquvw"}
    crossed = ["xy", "yxp", "yxq", "xux", "pxq", "qxp", "zvz", "wzzv"]
    rng = np.random.default_rng(3)
    drawn = ["".join(rng.choice(list("xyzpquvw"), rng.integers(2, 7))) for _ in range(45)]
    orders = ["".join(rng.permutation(list("xyzpquvw"))[: rng.integers(2, 8)]) for _ in range(60)]
    for group in (crossed, list(dict.fromkeys(drawn)), list(dict.fromkeys(orders))):
        texts = ["\n".join(line[c] for c in t) for t in group]
        got = rows_by_id(line_dedup.line_report(documents(spark, texts)))
        assert [got[i].n_removed for i in range(len(texts))] == _copied(texts)[0]
    # lines that no text repeats: the same as an alignment with every earlier text
    lines = [t.split("\n") for t in texts]
    every = [len({j for a in lines[:i] for _, j in plain_patience(a, b)}) for i, b in enumerate(lines)]
    assert [got[i].n_removed for i in range(len(texts))] == every
    assert line_dedup.patience(list("xux"), list("pxq")) in ([(0, 1)], [(2, 1)])


def test_a_passage_repeated_ever_more_often_takes_few_partners(spark, monkeypatch):
    passage = "one line of a passage here\nanother line of the passage\nthe last line of that passage"
    texts = ["\n".join([f"document {i} begins with its own words", *[passage] * (i + 1)]) for i in range(300)]
    tried = []
    plain = line_dedup.saved

    def counted(frame, name):
        frame = plain(frame, name)
        if name == "line-ranks":
            tried.append(frame.count())
        return frame

    monkeypatch.setattr(line_dedup, "saved", counted)
    got = rows_by_id(line_dedup.line_report(documents(spark, texts)))
    # the first document, then (i + 1) / 2 passages or more: those of the first document that holds it half as often
    assert got[0].n_removed == 0 and all(got[i].n_removed >= 3 * (i // 2) for i in range(300))
    assert len(tried) <= 3 and sum(tried) < 300 * 3 * 10


def test_few_pairs_are_few_tasks(spark, monkeypatch):
    """A round that has a handful of pairs left starts no more tasks than they need."""
    texts = ["alpha beta gamma delta epsilon\none", "zeta\nalpha beta gamma delta epsilon", "alpha beta gamma delta epsilon\nthree"] * 2
    docs = documents(spark, [t + f"\n{i}" for i, t in enumerate(texts)])
    frame = type(docs)
    asked, plain = [], frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, *a: asked.append(a[0]) or plain(df, *a))
    got = rows_by_id(line_dedup.line_report(docs))
    assert [r.n_removed > 0 for _, r in sorted(got.items())] == [False] + [True] * 5
    assert asked and set(asked) == {1}



@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9))
def test_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    found = line_dedup.longest_common(a, b)[::-1]
    assert len(found) == best[-1][-1] and all(a[i] == b[j] for i, j in found)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))


def test_blocks_of_short_lines_and_scripts_without_blanks(spark):
    verse = "\n".join(["red rose", "blue sky", "old oak"])
    chinese = "我们昨天在公园里看见了一只白色的猫"
    texts = [f"alpha\n{verse}", f"beta\n{verse}\ngamma", f"{chinese}\n一", f"二\n{chinese}", "alpha", "blue sky\nold oak"]
    got = rows_by_id(line_dedup.line_report(documents(spark, texts)))
    assert [got[i].n_removed for i in range(6)] == [0, 3, 0, 1, 0, 0]


def test_a_passage_of_lines_first_seen_apart_goes_from_very_many_documents(spark):
    notice = [f"part {c} of a notice on every page" for c in "abc"]
    texts = [f"{n}\nthe text of page {c} is its own" for n, c in zip(notice, "abc")]
    texts += ["\n".join([f"document {i} begins with its own words", *notice]) for i in range(105)]
    got = rows_by_id(line_dedup.line_report(documents(spark, texts)))
    assert [got[i].n_removed for i in range(3)] == [0] * 3
    assert {got[i].n_removed for i in range(3, len(texts))} == {3}


# ---------------------------------------------------------------- packing


def _packed(rows, sequences, counts, capacity):
    """Checks that a plan places every piece once, without gaps or overlaps."""
    used, fill = {}, {}
    for length, first, count, sequence, offset in rows:
        assert first == used.get(length, 0)
        used[length] = first + count
        for i in range(count):
            fill.setdefault(sequence + i, []).append((offset, length))
    assert used == {k: n for k, n in counts.items() if n}
    assert sorted(fill) == list(range(sequences))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_places_every_piece(counts):
    rows, sequences = packing.plan(counts, 64)
    _packed(rows, sequences, counts, 64)
    if counts:
        assert sequences >= math.ceil(sum(k * n for k, n in counts.items()) / 64)


def test_plan_is_near_the_lower_bound():
    rng = np.random.default_rng(6)
    lengths = np.minimum(2047, 1 + rng.lognormal(6.3, 0.9, 20_000).astype(int))
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    rows, sequences = packing.plan(counts)
    _packed(rows, sequences, counts, 2048)
    assert sequences <= 1.005 * math.ceil(lengths.sum() / 2048)


def test_packing_report_against_the_tokenizer(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(words(rng, int(n))) for n in rng.integers(1, 400, 40)] + [" ".join(words(rng, 5000)), "", None, "it's", "x" * 3000]
    got = packing.packing_report(documents(spark, texts).selectExpr("*", "1 AS length", "2 AS piece"), RANKS, public_tokenizers.PATTERN).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    import zlib

    pieces = {(r.doc_id, r.piece): r for r in got}
    assert len(pieces) == len(got)
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        mine = [pieces[i, p] for p in range(sum(k[0] == i for k in pieces))]
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
        assert sum(r.length for r in mine) == len(ids) and all(r.length == 2048 for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in fill.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)])]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048
    assert packing.packing_report(documents(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    twice = documents(spark, ["a b"]).union(documents(spark, ["a b"]))
    assert packing.packing_report(twice, RANKS, public_tokenizers.PATTERN).count() == 2


# ---------------------------------------------------------------- search


def test_top_k_agrees_with_all_scores(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [rng.integers(-9, 9, 12).astype(float) / 8 for _ in range(300)]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(300, None), (320, [None] + [1.0] * 11), (340, [float("nan")] * 12), (360, [float("inf")] * 12), (20, rows[20][1]), (None, rows[3][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS c", "'x' AS side")
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", 5)
    got = {}
    for r in topk.top_k(frame, "vec_id % 20 = 0", k=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    usable = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for at, (i, v) in enumerate(usable):
        if i is not None and i % 20 == 0:
            scores = sorted(((-int(v @ w), math.inf if j is None else j, j) for place, (j, w) in enumerate(usable) if place != at), key=lambda s: s[:2])[:7]
            want.setdefault(i, []).extend((rank + 1, j, -s) for rank, (s, _, j) in enumerate(scores))
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in want.items()}
    assert topk.top_k(frame.limit(0), "vec_id % 20 = 0").count() == 0


# ---------------------------------------------------------------- dialogues


def test_every_speaker_gets_a_perspective(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "BLOCK", 2)
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "Ann", "hi"), (1, 2, "Bob B", None), (1, 3, "Ann", "<|im_end|>"), (1, 3, "Ann", "<|im_end|>"),
        (2, 0, "system", "alone"), (None, None, None, "lost"), (None, 5, "x", "é"),
    ]
    rows = dialogue.perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS speaker", "2 AS start")).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (repr(r.conv_id), r.speaker, r.position)):
        told = whole.setdefault((r.conv_id, r.speaker), [""] + [[]])
        assert r.start == len(told[0])
        told[0] += r.segment
        if r.mask_start is not None:
            told[1].append(told[0][r.mask_start : r.mask_end])
    assert set(whole) == {(1, "Ann"), (1, "Bob B"), (None, "unknown"), (None, "x")}
    assert whole[1, "Bob B"][1] == ["<|im_end|>"]
    assert whole[1, "Ann"][1] == ["hi<|im_end|>", *["< |im_end|><|im_end|>"] * 2]
    assert whole[1, "Ann"][0].startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=Bob_B\n")
    assert whole[None, "x"][0] == "<|im_start|>assistant\né<|im_end|>\n<|im_start|>user name=unknown\nlost<|im_end|>\n"


# ---------------------------------------------------------------- queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, duck(SMALL), SMALL, name, queries.QUERIES[name], queries.SQL[name]).startswith("ok")


def test_pipeline_stages_on_the_small_table(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_copies", "personal_data", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == columns
        kept = {r.doc_id for r in after.collect()}
        assert kept and kept <= {r.doc_id for r in docs.collect()}
        if name == "near_copies":
            before = sorted(docs.collect(), key=lambda r: r.doc_id)
            _, group = brute_groups([r.text for r in before])
            assert sorted(group[[r.doc_id for r in before].index(i)] for i in kept) == sorted(set(group))
        docs = after
    assert set(stage_ids(corpus_pipeline.STAGES[-1][1](spark, docs, SMALL))) == {r.doc_id for r in docs.collect()}


def stage_ids(frame):
    return [r.doc_id for r in frame.select("doc_id").collect()]


def test_pipeline_of_odd_rows(spark, tmp_path):
    rows = [(1, "the same text of five words", "en", "s", 27), (1, "the same text of five words", "en", "s", 27), (2, None, "en", "s", None), (None, "", None, None, 0), (3, "1234", "en", "s", 4), (4, "write to a@b.cd about the house and the garden", None, "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS lang_pred", "2 AS _row")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(stage_ids(packed)) == [1, 4]
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
