"""Token counts, whitening and conversation repair against the tokenizer library, dense algebra and a plain search."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import ODD, documents, rows_by_id
from tokenizers import Tokenizer

from conftest import SMALL
from poolsift.llm import queries, token_counts, turns, varint, whitening
from poolsift.llm.common import table
from poolsift.llm.pieces import Splitter, class_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- token counts


def counted(frame):
    return token_counts.token_counts(frame, TOKENIZER, public_tokenizers.PATTERN)


def assert_counts(got, texts):
    library = Tokenizer.from_file(TOKENIZER)
    for i, text in enumerate(texts):
        text = text or ""
        tokens = len(library.encode(text, add_special_tokens=False))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(text.encode()), tokens, tokens > 1024), text[:40]


def test_counts_are_those_of_the_library(spark):
    special = ["a<|endoftext|>b", "<|endoftext|><|endoftext|> x ", "<|endoftext", "it's<|endoftext|>'s"]
    texts = [*ODD, *special, None, "", "word " * 2000, "word " * 2000, "日本" * 3000]
    frame = documents(spark, texts).selectExpr("*", "1 AS batch", "2 AS word", "3 AS n_tokens")
    assert_counts(rows_by_id(counted(frame)), texts)


def test_very_long_texts_are_cut_where_pieces_end(spark):
    texts = ["word " * 300_000, "x1" * 600_000, "'s" * 600_000, " " * 1_200_000 + "a", "a'" * 700_000, "日本。" * 400_000]
    assert_counts(rows_by_id(counted(documents(spark, texts))), texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**40), max_size=6), max_size=6), st.integers(0, 3))
def test_packed_lists_come_back(rows, skip):
    flat, ends = np.array(sum(rows, []), np.int64), np.cumsum([len(r) for r in rows]).astype(np.int64)
    column = varint.packed(flat, ends)
    values, stops = varint.unpacked(column[min(skip, len(rows)) :])
    kept = rows[skip:]
    assert values.tolist() == sum(kept, []) and stops.tolist() == np.cumsum([len(r) for r in kept]).astype(int).tolist()
    rising = np.array(sum([sorted(r) for r in rows], []), np.int64)
    assert varint.from_steps(varint.steps(rising, ends), ends).tolist() == rising.tolist()
    words = [str(v).encode() * (v % 3) for v in flat]
    body, sizes = varint.joined(words, ends)
    assert varint.split(body, varint.unpacked(sizes)[0]) == words


def test_safe_parts_give_the_pieces_of_the_whole():
    rng = random.Random(3)
    splitter = Splitter(public_tokenizers.PATTERN, class_table(public_tokenizers.PATTERN))
    for _ in range(300):
        text = "".join(rng.choice(["a", "s", "'s", "'", " ", "  ", "\n", "1", "!", "é", "日", "ll"]) for _ in range(60))
        parts = list(token_counts.safe_parts(text, splitter.classes, most=5))
        assert "".join(parts) == text
        assert [p for part in parts for p in splitter.slow.findall(part)] == splitter.slow.findall(text)


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    frame = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a"), (1, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counted(frame).collect()) == [(0, 2), (0, 2), (1, 0), (1, 1)]
    assert counted(frame.limit(0)).collect() == []


def test_pieces_with_one_name_are_told_apart(spark, monkeypatch):
    words = token_counts.WordList()
    splitter = Splitter(public_tokenizers.PATTERN)
    codes, starts, _ = splitter.cuts(["aa bb cc"])
    plain = token_counts.WordList._name
    monkeypatch.setattr(token_counts.WordList, "_name", staticmethod(lambda t, w, s, n, which: plain(t, w, s, n, which) % np.uint64(2) if which == 0 else plain(t, w, s, n, which)))
    assert words.numbers(codes, starts) is None
    number, fresh = words.numbers(codes, starts)
    assert [fresh[n] for n in number] == ["aa", " bb", " cc"]


def test_a_table_is_counted_whole(spark):
    docs = table(spark, SMALL, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = rows_by_id(queries.QUERIES["op11_tokens"](spark, SMALL))
    assert got.keys() == texts.keys()
    library = Tokenizer.from_file(TOKENIZER)
    ids = sorted(texts)
    for i, e in zip(ids, library.encode_batch([texts[i] or "" for i in ids], add_special_tokens=False)):
        assert got[i].n_tokens == len(e)


# ---------------------------------------------------------------- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [None if x is None else float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3)


def assert_whitened(got, rows, wanted=32):
    """Whole numbers, dense covariance and its eigenvectors, next to the result; signs may differ per component."""
    x = np.floor(64 * np.array([rows[i] for i in sorted(rows)])).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = (x - 1_000_000) - (sums - 1_000_000 * n) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    count = min(wanted, int((values > 1e-12 * values[0]).sum()))
    assert got.groupby("vec_id").component.apply(lambda c: sorted(c) == list(range(1, count + 1))).all()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[sorted(rows)].to_numpy()
    plain = centred @ directions[:, :count] / np.sqrt(values[:count])
    assert np.abs(np.abs((wide * plain).sum(0) / n) - 1).max() < 1e-9
    sign = np.sign((wide * plain).sum(0))
    assert np.abs(wide * sign - plain).max() < 1e-6
    first = got.drop_duplicates("vec_id").set_index("vec_id").loc[sorted(rows)]
    assert first.deviation.tolist() == [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums))) for r in x]
    assert set(got.n) == {n}
    shares = got.groupby("component").explained.first().to_numpy()
    assert np.abs(shares / (values[:count] / values.sum()) - 1).max() < 1e-8
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-8


@pytest.mark.parametrize("name", ["few", "wide", "steep"])
def test_whitening_agrees_with_dense_algebra(spark, name):
    rng = np.random.default_rng(5)
    rows = {
        "few": rng.standard_normal((60, 5)) + 3,
        "wide": rng.standard_normal((150, 45)) * np.linspace(1, 3, 45),
        "steep": rng.standard_normal((200, 12)) * np.logspace(4, 0, 12),
    }[name]
    got = whitening.whitened(vectors(spark, rows).selectExpr("*", "1 AS x", "2 AS component")).toPandas()
    assert_whitened(got, dict(enumerate(rows.tolist())))


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(6)
    rows = [*rng.standard_normal((30, 3)).tolist(), None, [1.0, None, 2.0], [float("nan"), 0, 0], [float("inf"), 0, 0], []]
    got = whitening.whitened(vectors(spark, rows)).toPandas()
    assert_whitened(got, {i: rows[i] for i in range(30)})


def test_low_rank_and_repeated_deviations(spark):
    rng = np.random.default_rng(7)
    low = np.round(rng.standard_normal((80, 2)) * 10) @ np.array([[1, 0, 2, 0, 1], [0, 1, 0, 1, 1]])
    got = whitening.whitened(vectors(spark, low)).toPandas()
    assert set(got.component) == {1, 2} and got.identity_error.max() < 1e-9
    even = np.vstack([np.eye(6), -np.eye(6)] * 3)
    got = whitening.whitened(vectors(spark, even)).toPandas()
    assert set(got.component) == set(range(1, 7)) and got.identity_error.max() < 1e-9
    assert np.allclose(got.explained, 1 / 6)


def test_steps_end_early_where_components_have_converged():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 60)) * np.concatenate([np.linspace(50, 100, 4), np.full(56, 0.01)])
    x -= x.mean(0)
    steps = 0

    def multiply(q, w):
        nonlocal steps
        steps += 1
        p = x @ q
        return x.T @ p, (x @ w).T @ p, p @ p

    found, right = whitening.bidiagonalise(multiply, 60, 4, np.linalg.norm(x))
    assert np.allclose(found, np.linalg.svd(x, compute_uv=False)[:4], rtol=1e-12) and steps < 30
    assert np.allclose(right.T @ right, np.eye(4), atol=1e-12)


def test_equal_vectors_empty_tables_and_errors(spark):
    assert whitening.whitened(vectors(spark, [[1.0, 2.0]] * 4)).collect() == []
    assert whitening.whitened(vectors(spark, [[1.0]]).limit(0)).collect() == []
    with pytest.raises(ValueError, match="entries in one table"):
        whitening.whitened(vectors(spark, [[1.0], [1.0, 2.0]]))
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(vectors(spark, [[1e300], [2.0]])).collect()
    with pytest.raises(Exception, match="does not fit a long"):
        whitening.whitened(vectors(spark, [[1e9], [2.0], [5.0]])).collect()


def test_deviations_are_exact_beyond_64_bits():
    x = np.array([[2**40, 5], [-(2**40), 7], [3, 9]])
    centre = whitening.Centre(3, [int(s) for s in x.sum(0)])
    assert centre.deviations(x) == [sum((3 * int(a) - int(s)) ** 2 for a, s in zip(r, x.sum(0))) for r in x]


# ---------------------------------------------------------------- conversations


def plainly(rows):
    """The report by definition: damage, faults, and a search over (rows used, state) by cost, then edits."""
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, said in held.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        numbers = [r[0] for r in said if r[0] is not None]
        faults, seen = [], set()
        for _, role, text in said:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, edits, repaired = cheapest(said, faults)
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:])),
            cost,
            edits,
            hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
        )
    return out


def cheapest(said, faults):
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, edits, i, state, out = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(said) and state in ("", "a"):
            return cost, edits, out
        new = "assistant" if state == "u" else "user"
        heapq.heappush(queue, (cost + 3, edits + "I", i, new[0], (*out, new + ":")))
        if i == len(said):
            continue
        _, role, text = said[i]
        heapq.heappush(queue, (cost + 4, edits + "D", i + 1, state, out))
        if faults[i] in ("blank", "duplicate"):
            continue
        more = cost + (3 if faults[i] == "truncated" else 0)
        heapq.heappush(queue, (more + 3, edits + "R", i + 1, new[0], (*out, f"{new}:{text}")))
        if role[:1] == new[0] or role[:1] == "s" and state == "":
            heapq.heappush(queue, (more, edits + "K", i + 1, role[0], (*out, f"{role}:{text}")))


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def reported(frame, **options):
    rows = turns.repair_report(frame, **options).collect()
    found = {r.conv_id: tuple(r[f] for f in FIELDS) for r in rows}
    assert len(found) == len(rows)
    return found


def odd_conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in (None, *range(1, 9)):
        for _ in range(rng.choice([1, 2, 3, 30, 120])):
            role = rng.choice([None, "user", "assistant", "system", "tool", "", "a", "user", "assistant"])
            text = rng.choice(["", "Hi.", "x", "Yes!\n", "what? ", "no", "é?", "a.b", " \x0b"]) + rng.choice(["", "1", f"{rng.randrange(90)}."])
            rows.append((conv, rng.choice([None, rng.randrange(60), rng.randrange(60)]), role, rng.choice([text, text, text, None])))
    return rows + rows[:20]


@pytest.mark.parametrize("seed, most", [(1, 4096), (2, 3), (3, 1)])
def test_repair_is_the_cheapest_and_least(spark, seed, most):
    rows = odd_conversations(seed)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert reported(frame.selectExpr("*", "1 AS copies", "2 AS fault", "3 AS part").repartition(5), most=most) == plainly(rows)


def test_one_conversation_in_many_tasks(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"{i} {rng.choice(['yes.', 'no'])}") for i in range(2_000)] + [(2, 0, "user", "Hi."), (0, 5, "assistant", "Ho.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert reported(frame, most=64) == plainly(rows)


def test_given_conversations(spark):
    frame = table(spark, SMALL, "conversations")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in frame.collect()]
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in queries.QUERIES["op13_turns"](spark, SMALL).collect()}
    assert got == plainly(rows)


def test_empty_table_and_dropped_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert reported(spark.createDataFrame([], schema)) == {}
    dropped = next(i for i in range(1000) if zlib.crc32(f"7:{i}".encode()) % 20 == 0)
    got = reported(spark.createDataFrame([(7, dropped, "user", "Hi.")], schema))
    assert got == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_memory_of_the_search_is_its_unresolved_part():
    survivors = turns.Survivors(turns.START, free=True)
    rng = random.Random(4)
    longest = 0
    for i in range(5_000):
        survivors.step(turns.row_moves(rng.choice("uuaas"), rng.choice([0, 0, 0, 3, 2]), 1))
        longest = max(longest, max(n.depth for _, n in survivors.paths.values()) - survivors.root.depth)
    assert longest < 200
