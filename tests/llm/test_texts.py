"""Operators over single texts against brute force: fingerprints, tokens, languages, personal data."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import ODD, documents, rows_by_id

from poolsift.llm import bpe, language, pii, simhash
from poolsift.llm.pieces import Splitter

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, PATTERN)


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


# ---------------------------------------------------------------- fingerprints


def test_fingerprint_report_edits_with_the_next_document(spark):
    texts = ["alpha beta gamma delta", "one two three four five six", "alpha beta gamma delta", "", None, "x", "é" * 31]
    got = rows_by_id(simhash.fingerprint_report(documents(spark, texts)))
    plain = [t or "" for t in texts]
    for i, text in enumerate(plain):
        after = plain[i - 1] if i else plain[-1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[0].fingerprint == got[2].fingerprint and got[0].n_near == 1
    assert got[3].fingerprint == got[4].fingerprint == "0" * 32
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def test_next_document_crosses_ranges_and_ids_may_be_null_or_repeat(spark):
    rows = [(5, "five a b"), (10**12, "far away c"), (7, "seven d e"), (None, "none f g"), (7, "seven d e"), (-3, "minus h")]
    got = simhash.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1]))
    want = []
    for i, (doc_id, text) in enumerate(order):
        half = len(text) // 2
        edited = text[: len(text) - half] + order[(i + 1) % len(order)][1][:half]
        want.append((doc_id, hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)


def test_fingerprint_is_the_weighted_majority(spark):
    text = " ".join(f"word{i % 7} and{i}" for i in range(1500))
    words = text.split()
    terms = spark.createDataFrame([(a, b) for a, b in zip(words, words[1:])], "a string, b string")
    hashed = terms.selectExpr("xxhash64(a, b) AS l", "xxhash64(xxhash64(a, b)) AS h", "least(length(a) + length(b), 31) AS w").collect()
    want = []
    for name in ("h", "l"):
        bits = 0
        for bit in range(64):
            ones = sum(r.w for r in hashed if (r[name] >> bit) & 1)
            if 2 * ones > sum(r.w for r in hashed):
                bits |= 1 << bit
        want.append(f"{bits:016x}")
    got = simhash.fingerprints(documents(spark, [text]), ["doc_id"]).first()
    assert [f"{got.high & (2**64 - 1):016x}", f"{got.low & (2**64 - 1):016x}"] == want


def test_block_tables_find_every_fingerprint_in_the_radius(spark):
    rng = np.random.default_rng(4)
    prints = {(int(a), int(b)) for a, b in rng.integers(-(2**62), 2**62, (40, 2))}
    for high, low in list(prints):
        for _ in range(6):
            for bit in rng.choice(128, rng.integers(1, 10), replace=False):
                high, low = (high ^ (1 << int(bit)), low) if bit < 63 else (high, low ^ (1 << (int(bit) - 63) % 63))
            prints.add((high, low))
    rows = [(h, l, i % 3 + 1) for i, (h, l) in enumerate(sorted(prints))]
    frame = spark.createDataFrame(rows, "high long, low long, copies long")

    def apart(a, b):
        return bin((a[0] ^ b[0]) & (2**64 - 1)).count("1") + bin((a[1] ^ b[1]) & (2**64 - 1)).count("1")

    want = {}
    for a in rows:
        n = sum(b[2] for b in rows if 0 < apart(a, b) <= simhash.RADIUS)
        if n:
            want[a[:2]] = n
    assert want
    for chunk in (512, 2):
        got = {(r.high, r.low): r.n_near for r in simhash.near_counts(frame, chunk=chunk).collect()}
        assert got == want


def test_empty_tables(spark):
    none = documents(spark, [])
    assert simhash.fingerprint_report(none).count() == 0
    assert pii.personal_data_report(none).count() == 0
    assert language.language_report(none.selectExpr("*", "cast(null as string) AS lang")).count() == 0
    assert bpe.round_trip_report(none, RANKS, PATTERN).count() == 0


# ---------------------------------------------------------------- tokens


def test_codec_agrees_with_the_library(codec, encoding):
    ids, counts = codec.encode(ODD)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [encoding.encode_ordinary(t) for t in ODD]
    assert codec.decode(ids, counts) == [t.encode() for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab '\"\n\t  ’sdtrevml中١²½_#%🙂\x1c\x00é", max_size=60), max_size=8))
def test_codec_agrees_on_any_text(codec, encoding, texts):
    ids, counts = codec.encode(texts)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []
    assert got == [encoding.encode_ordinary(t) for t in texts]
    assert codec.decode(ids, counts) == [t.encode() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=80))
def test_splitter_agrees_with_the_pattern(text):
    splitter = _splitter()
    codes, starts, counts = splitter.cuts([text, "a", text])
    ends = [*starts.tolist(), len(codes)]
    whole = text + "a" + text
    assert [whole[a:b] for a, b in zip(ends, ends[1:])] == [*splitter.slow.findall(text), "a", *splitter.slow.findall(text)]


def _splitter(made=[]):  # noqa: B006  (the class table takes a second to build)
    if not made:
        made.append(Splitter(PATTERN))
    return made[0]


def test_letters_newer_than_pythons_tables(codec, encoding):
    text = "".join(f"ab{chr(c)}12{chr(c)} {chr(c)}" for c in (0x13460, 0x105C0, 0x10D40, 0x3347A))
    ids, _ = codec.encode([text])
    assert ids.tolist() == encoding.encode_ordinary(text)


def test_long_pieces_follow_the_same_rule(codec, encoding):
    for piece in ("ab" * 400, "aaaaaaab" * 60, "the" * 300):
        assert codec.encode_pieces([piece])[0].tolist() == encoding._encode_single_piece(piece)


def test_round_trip_report(spark, encoding):
    got = rows_by_id(bpe.round_trip_report(documents(spark, [*ODD, None]).selectExpr("*", "1 AS ids", "2 AS n_tokens"), RANKS, PATTERN))
    for i, text in enumerate([*ODD, ""]):
        ids = encoding.encode_ordinary(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_encode_decode_returns_ids_and_bytes(spark, encoding):
    got = rows_by_id(bpe.encode_decode(documents(spark, ["one two", None]), RANKS, PATTERN))
    assert got[0].ids == encoding.encode_ordinary("one two") and bytes(got[0].decoded) == b"one two"
    assert got[1].ids == [] and bytes(got[1].decoded) == b""


# ---------------------------------------------------------------- languages

ENGLISH = "the quick brown fox jumps over the lazy dog and runs through the forest with its friends "
GERMAN = "der schnelle braune fuchs springt über den faulen hund und läuft durch den wald mit seinen freunden "


def _phrases(sample, text):
    """Greedy longest matches, by searching the sample."""
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and sample.find(text[at:end]) >= 0:
            end += 1
        at = max(at + 1, end - 1)
        count += 1
    return count


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=30), st.text(alphabet="abcd", min_size=1, max_size=30))
def test_automaton_counts_longest_matches(sample, text):
    code = {c: i + 2 for i, c in enumerate("abc")} | {"d": 0}
    table = language.parse_table(*language.compact(language.suffix_automaton([code[c] for c in sample])))
    steps = np.array([[code[c]] for c in text], np.uint8)
    assert language.count_phrases(table, steps, np.array([len(text)])).tolist() == [_phrases(sample, text)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=30), st.text(alphabet="abcd", min_size=1, max_size=30))
def test_list_of_moves_counts_the_same_phrases(sample, text):
    code = {c: i + 1 for i, c in enumerate("abc")} | {"d": 0}
    automaton = language.compact(language.suffix_automaton([code[c] for c in sample]))
    steps = np.array([[code[c]] for c in text], np.uint8)
    got = language.count_phrases_by_list(language.move_list(*automaton, 4), steps, np.array([len(text)]))
    assert got.tolist() == [_phrases(sample, text)]


def test_letters_of_all_samples_are_told_apart(monkeypatch):
    scripts = {
        "ar": (0x627, 0x64A), "el": (0x3B1, 0x3C9), "en": (0x61, 0x7A), "ja": (0x3041, 0x3096), "ko": (0xAC00, 0xB800),
        "ru": (0x430, 0x44F), "th": (0xE01, 0xE2E), "tr": (0x130, 0x131), "zh": (0x4E00, 0x5A00),
    }
    rng = np.random.default_rng(5)

    def drawn(low, high):
        return "".join(chr(c) for c in rng.integers(low, high + 1, 3000))

    samples = [(name, drawn(*ends)) for name, ends in scripts.items()]
    texts = [drawn(*ends)[:200] for ends in scripts.values()]
    classes = language.character_classes([text for _, text in samples])
    letters = {language._folded(c) for _, text in samples for c in text if c.isalpha()}
    assert len({int(classes[ord(c)]) for c in letters}) == len(letters) and min(classes[ord(c)] for c in letters) > 1
    model = language.learn(samples)
    found = []
    for bound in (language.DENSE, 0):
        monkeypatch.setattr(language, "DENSE", bound)
        classes, _, tables = language.unfold(model)
        found.append(language.entropies(texts, classes, tables, model["bits"]))
        assert found[-1].argmin(1).tolist() == list(range(len(scripts)))
    assert (found[0] == found[1]).all()


def test_language_report(spark):
    texts = [(ENGLISH if i % 2 else GERMAN) * (1 + i % 3) for i in range(40)] + [None, "", "12345 !!", ENGLISH * 60, "É"]
    langs = [("en" if i % 2 else "de") for i in range(40)] + [None] * 5
    docs = spark.createDataFrame(list(zip(range(45), texts, langs)), "doc_id long, text string, lang string")
    got = rows_by_id(language.language_report(docs.selectExpr("*", "'x' AS lang_pred", "'y' AS held_out")))
    assert [got[i].lang_pred for i in range(40)] == langs[:40]
    assert [got[i].lang_pred for i in (40, 41, 42)] == ["und"] * 3 and got[40].score == 0
    assert got[43].lang_pred == "en" and 0.5 < got[43].score <= 1
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_rows_are_not_learnt_from(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "'abc' AS text", "IF(crc32(cast(string(id) AS binary)) % 4 = 2, 'out', 'in') AS lang")
    assert [name for name, _ in language.training_sample(docs)] == ["in"]


def test_long_text_is_parsed_whole():
    classes = language.character_classes([ENGLISH, GERMAN])
    model = language.learn([("en", ENGLISH), ("de", GERMAN)])
    classes, _, tables = language.unfold(model)
    text = GERMAN * 5 + ENGLISH * 200
    bits = language.entropies([text, ENGLISH], classes, tables, model["bits"])
    assert bits[0].argmin() == 0 and bits[1].argmin() == 0


# ---------------------------------------------------------------- personal data

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(EMAIL, text)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(CARD, text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(f"card:{m.start()}:{m.end()}")
    out += [f"phone:{m.start()}:{m.end()}" for m in re.finditer(PHONE, text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


TEXTS = [
    "mail a.b@c.de.fg and x@y.z@q.r, a@b.c_d@e.f",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 9.9.9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1112 378282246310005 4111  1111",
    "+1 (988) 555-2485, +49.30.123 456 78 +1+22222222222 + 123456789",
    "🙂é a@b.cd 🙂 10.0.0.1",
    "iban DE89370400440532013000 and DE89370400440532013001",
    "SSN 123-45-6789",
    "order no 123-45-6789 or 555-123-4567",
    "Call (555) 123-4567",
    "a" * 3000 + "@" + "b" * 3000 + " " + "1" * 4000 + " " + "1 " * 3000,
    "",
    None,
    "nothing here",
]


def test_base_spans_agree_with_the_plain_patterns(spark):
    rng = np.random.default_rng(8)
    noise = ["".join(rng.choice(list("a1.@+- ()4é_%"), 120)) for _ in range(150)]
    texts = TEXTS + noise + ["".join(rng.choice(list("0123456789 -"), 60)) for _ in range(60)]
    got = rows_by_id(pii.personal_data_report(documents(spark, texts)))
    for i, text in enumerate(texts):
        want = base_spans(text or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(
            sum(w.startswith(k + ":") for w in want) for k in ("email", "ip", "card", "phone")
        )
        listed = got[i].spans.split(",") if got[i].spans else []
        assert [s for s in listed if s.split(":")[0] in pii.BASE] == want


def test_checksums_and_context_add_spans(spark):
    got = rows_by_id(pii.personal_data_report(documents(spark, TEXTS)))
    assert got[5].spans == "iban:5:27"
    assert [got[i].spans for i in (6, 7, 8)] == ["national_id:4:15", "", "local_phone:5:19"]


@pytest.mark.parametrize("number", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "XX31 ABCD 0000 0012"])
def test_account_numbers_before_capitals_and_digits(spark, number):
    if number.startswith("XX"):  # a country that no registry names
        turned = "".join(str(int(c, 36)) for c in number.replace(" ", "")[4:] + "XX00")
        number = f"XX{98 - int(turned) % 97:02d}{number[4:]}"
    behind = ["", " Bank of X", " The rest", " BIC COBADEFF", " 2024 paid", " A", ".", " NL91ABNA0417164300", " MT84 MALT 0110 0001 2345 MTLC AST0 01S X"]
    texts = [f"IBAN {number}{b}" for b in behind] + [f"IBAN {number}x", f"IBAN {number}é"]
    got = rows_by_id(pii.personal_data_report(documents(spark, texts)))
    own = f"iban:5:{5 + len(number)}"
    for i, b in enumerate(behind):
        want = [own] + ([f"iban:{6 + len(number)}:{len(texts[i]) - 2 * b.endswith(' X')}"] if b.startswith((" NL", " MT")) else [])
        assert [s for s in got[i].spans.split(",") if s.startswith("iban")] == want, texts[i]
    assert "iban" not in got[len(behind)].spans
    masked = rows_by_id(pii.mask_personal_data(documents(spark, texts[:2])))
    assert masked[1].text == "IBAN [IBAN] Bank of X"


def test_masking_keeps_other_columns(spark):
    docs = spark.createDataFrame(
        [(1, "write a@b.cd or 10.0.0.1", "k"), (2, None, None), (2, "plain", "é"), (None, "+49 30 1234567, 4111111111111111", "x")],
        "doc_id long, text string, spans string",
    )
    got = sorted(map(tuple, pii.mask_personal_data(docs).collect()), key=repr)
    want = [(1, "write [EMAIL] or [IP]", "k"), (2, None, None), (2, "plain", "é"), (None, "[PHONE], [CARD]", "x")]
    assert got == sorted(want, key=repr)
