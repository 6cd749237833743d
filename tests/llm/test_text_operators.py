import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesake.llm import chat_format, fingerprints, language_id, license_scan, mixing, quality
from namesake.llm.license_rules import _FAMILIES, _LEADS, _SENTENCES, LONGEST, rules

from .conftest import SCHEMA, odd_rows, words

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TINY = "/root/testdata/sf0.001"


# Quality rules


def counts(text):
    text = text or ""
    w = re.findall(WORD, text)
    runs = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_counts_match_brute_force(spark, small_docs):
    found = {r.doc_id: tuple(r)[1:7] for r in quality.op5_quality(spark, TINY).collect()}
    assert found == {r[0]: counts(r[1]) for r in small_docs}


def test_quality_of_odd_rows(odd, empty):
    found = quality.judge(odd).collect()
    assert sorted(tuple(r)[1:7] for r in found) == sorted(counts(r[1]) for r in odd_rows())
    assert all(not r.kept for r in found if r.base_failed)
    assert quality.judge(empty).count() == 0


def test_quality_thresholds_adapt_to_their_group(spark):
    plain = [(i, words(80, i), "en", "prose", 1) for i in range(300)]
    marked = [(1000 + i, " | ".join(words(80, i).split()), "en", "tables", 1) for i in range(300)]
    bad = [(5000, " | ".join(words(80, 9).split()), "en", "prose", 1)]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(plain + marked + bad, SCHEMA)).filter("kept").collect()}
    assert kept == {r[0] for r in plain + marked}


def test_quality_thresholds_decide_rows_of_the_tables(spark):
    """On sf0.1: thresholds differ between languages and between sources, and reject texts that the base rules keep."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    measured = quality.measure(docs).filter("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words")
    features = measured.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(F.expr(e).alias(k) for k, e in quality._FEATURES.items()))
    sketch = quality.sketches(features, ("g_lang", "g_source"))
    for by in (("g_lang",), ("g_lang", "g_source")):
        highs = [r.t_word_length for r in quality.thresholds(quality.merged(sketch, by), by).collect()]
        assert len(set(highs)) > 0.5 * len(highs) > 1
    values = sorted(r[0] for r in features.filter("g_lang = 'en'").select("word_length").collect())
    en = quality.thresholds(quality.merged(sketch, ("g_lang",)), ("g_lang",)).filter("g_lang = 'en'").first()
    q25, q50 = (values[-(-len(values) * q // 100) - 1] for q in (25, 50))
    assert abs(en.t_word_length - (q50 + quality.FENCE * (q50 - q25))) < 2 * quality.FENCE * 0.0025 * q50
    judged = quality.judge(docs).filter("not base_failed")
    assert 0 < judged.filter("not kept").count() < 0.1 * judged.count()


def test_sketches_merge_to_the_whole(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), *(F.col("id").alias(k) for k in quality._FEATURES))
    parts = quality.merged(quality.sketches(df, ("g",)).withColumn("all", F.lit(0)), ("all",))
    whole = quality.sketches(df.withColumn("all", F.lit(0)), ("all",))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    high = quality.thresholds(whole, ("all",)).first()["t_symbols"]
    assert abs(high - (500 + quality.FENCE * 250)) < 0.05 * high


# Language


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.op6_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    right, all_, held = found.filter("held_out").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.first("held_out")).first()
    assert held and all_ > 200 and right >= 0.98 * all_
    import zlib

    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out and 0 <= r.score <= 1 for r in found.collect())


def test_language_of_odd_rows(spark, odd, empty):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    filters = language_id.learn(docs)
    found = language_id.identify(odd, filters, carry=("doc_id", "text")).collect()
    assert len(found) == len(odd_rows())
    for r in found:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert r.lang_pred in (*filters.languages, "und")
    assert language_id.identify(empty, language_id.learn(empty)).count() == 0
    nothing = language_id.learn(empty)
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}


def test_bit_slices_hold_every_language_and_few_others():
    rng = np.random.default_rng(1)
    grams = {f"l{i:03}": rng.integers(0, 1 << 32, 500) for i in range(70)}
    f = language_id.LanguageFilters.build(grams)
    for i, name in enumerate(f.languages):
        p = language_id._positions(grams[name].astype(np.uint64), f.slices.shape[1])
        hit = np.bitwise_and.reduce([f.slices[i // 64, x] for x in p]) >> np.uint64(i % 64) & np.uint64(1)
        assert hit.all()
    probe = language_id._positions(rng.integers(1 << 33, 1 << 34, 20_000).astype(np.uint64), f.slices.shape[1])
    rate = np.mean(np.bitwise_and.reduce([f.slices[0, x] for x in probe]) & np.uint64(1))
    assert abs(rate - f.false_positive[0]) < 0.01


def test_a_text_is_judged_alone():
    grams = {"x": np.arange(1 << 16), "y": np.array([0x61626320])}
    f = language_id.LanguageFilters.build(grams)
    texts = [b"abc", b"zq", b"abc ab", b"", b"q", b"bcd"]
    together = f.coverage(texts)
    assert (together == np.concatenate([f.coverage([t]) for t in texts])).all()
    found = language_id._grams(texts)
    assert found[0].tolist() == [0x61626320, 0x61626320, 0x62632061, 0x63206162, 0x62636420] and found[1].tolist() == [0, 2, 2, 2, 5]


# Fingerprints


def shingles(text):
    w = re.findall(WORD, text.lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def edited(rows):
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        out.append((i, text, text[: len(text) - half] + after[:half], after))
    return out


def test_fingerprints_of_whole_table(spark, small_docs):
    found = {r.doc_id: r for r in fingerprints.op7_fingerprints(spark, TINY).collect()}
    rows = edited(sorted((r[0], r[1] or "") for r in small_docs))
    errors, same = [], {}
    for i, text, other, after in rows:
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(other.encode()).hexdigest())
        assert same.setdefault(text, r.fingerprint) == r.fingerprint and same.setdefault(other, r.edited_fingerprint) == r.edited_fingerprint
        for estimate, b in ((r.near_edited, other), (r.near_next, after)):
            x, y = shingles(text), shingles(b)
            errors.append(estimate - (len(x & y) / len(x | y) if x | y else 1))
    assert np.sqrt(np.mean(np.square(errors))) < 0.05 and abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.25


def test_fingerprints_of_odd_rows(odd, empty, spark):
    found = fingerprints.fingerprints(odd).collect()
    assert len(found) == len(odd_rows())
    assert sorted(r.n_chars for r in found) == sorted(len(r[1] or "") for r in odd_rows())
    assert all((r.fingerprint == "") == (r.n_chars in (0, 4) and r.doc_id in (None, 10, 11, 12)) for r in found if r.doc_id != 13)
    assert fingerprints.fingerprints(empty).count() == 0
    one = fingerprints.fingerprints(spark.createDataFrame([(1, "a b c d e f", None, None, None)], SCHEMA)).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()


# Licences


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = sorted((k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x[1] for x in at}))


def test_license_base_of_whole_table(spark, small_docs):
    for r in license_scan.op4_license_scan(spark, TINY).collect():
        text = next(t for i, t, *_ in small_docs if i == r.doc_id)
        assert tuple(r)[1:6] == base(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_texts(spark):
    texts = [
        "The MIT License, the mit-license; permit license mit licenses", "under the terms of the GNU General\n * Public License", "CC BY-NC-SA 4.0 and cc  by", "SPDX-License-Identifier: Apache-2.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "Licensed under the Apache License, Version 2.0", "All rights reserved.", "éMIT License", "mit license mit license", "", None, "gnu general public license apache license",
        "All right, no mitten licence", "www.gnu.org/licenses/lgpl-3.0.html",
    ]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for i, t in enumerate(texts):
        assert tuple(found[i])[1:6] == base(t), t
    labels = {i: r.labels for i, r in found.items()}
    assert labels[3] == "apache" and found[3].score == 1.0 and labels[4] == "mit" and labels[6] == "proprietary" and labels[12] == "" and labels[13] == "lgpl"
    assert found[2].labels.split(",")[:1] == ["cc-by"] and "cc-by-nc-sa" in found[2].labels
    assert [d.rule for d in found[5].detections] and len(found[5].detections) == 1  # the declaration swallows the name inside


def test_license_of_odd_rows(odd, empty):
    assert sorted(map(repr, (tuple(r)[1:6] for r in license_scan.scan(odd).collect()))) == sorted(repr(base(r[1])) for r in odd_rows())
    assert license_scan.scan(empty).count() == 0


def test_license_rules_are_sound():
    found = rules()
    assert len(found) > 300 and [r.priority for r in found] == sorted(r.priority for r in found)
    gate = re.compile(license_scan.gate(found))
    for r in found:
        re.compile(r.pattern.replace(r"\x{10ffff}", "\U0010ffff"))
        assert gate.search(f" {r.keyword}") or gate.search(f"-{r.keyword}"), r
    assert LONGEST >= 100


def test_containment_matches_brute_force(spark):
    texts = ["licensed under the mit license and released under the gnu general public license version 2. the mit license. apache license 2.0 " * 3]
    found = [r for r in rules()]
    got = license_scan.scan(spark.createDataFrame([(1, texts[0], None, None, None)], SCHEMA)).first().detections
    every = []
    for k, r in enumerate(found):
        pattern = re.compile(r.pattern.replace(r"\x{10ffff}", "\U0010ffff"))
        every += [(m.start(), -m.end(), r.priority, k, r.label) for m in pattern.finditer(texts[0]) if r.keyword in texts[0]]
    every.sort()
    kept = [x for i, x in enumerate(every) if not any(y[0] <= x[0] and -y[1] >= -x[1] and y[2] <= x[2] for y in every[:i])]
    assert [tuple(d) for d in got] == kept


def detected(text):
    """All patterns without any gate, then containment."""
    low = text.translate(LOWER)
    every = sorted((m.start(), -m.end(), r.priority, k, r.label) for k, r in enumerate(rules()) for m in re.finditer(r.pattern.replace(r"\x{10ffff}", "\U0010ffff"), low))
    return [x for i, x in enumerate(every) if not any(y[0] <= x[0] and -y[1] >= -x[1] and y[2] <= x[2] for y in every[:i])]


def test_no_gate_hides_a_match(spark):
    words = [w for _, w in _SENTENCES] + [n for f in _FAMILIES for n in f[1]]
    words += [f"{_LEADS[k % len(_LEADS)]} the {n}" for k, n in enumerate(n for f in _FAMILIES for n in f[1])]
    words = [w.replace("[sc]", "s").replace("v?", "") for w in words]
    texts = [gap.join(w.split()) for w in words for gap in (" ", "\n * ", "-", ' "')]
    texts += [f"{before}{x}" for f in _FAMILIES for x in (*f[2], *f[3]) for before in ("", "SPDX-License-Identifier: ", "xSPDX-License-Identifier:\t", "see www.", "see x")]
    texts += ["CC BY SA 4.0", "CC BY NC 4.0", "all  rights\nreserved", "Permission\nis hereby granted, free of charge, to any person obtaining a copy", "GNU Lesser\n * General Public License", "the licence of a library in the public interest"]
    found = license_scan.scan(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)).collect()
    wanted = [detected(t) for t in texts]
    assert {k for w in wanted for *_, k, _ in w} == set(range(len(rules())))
    for r in found:
        assert [tuple(d) for d in r.detections] == wanted[r.doc_id], texts[r.doc_id]
    labels = {texts[r.doc_id]: r.labels for r in found}
    assert labels["CC BY SA 4.0"] == "cc-by,cc-by-sa" and labels["all  rights\nreserved"] == "proprietary"


# Chats


def test_chats_of_whole_table(spark):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{TINY}/conversations.parquet").to_pylist()
    turns = {}
    for r in sorted(rows, key=lambda r: r["turn"]):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-7] = [("user", chat_format.HOSTILE[1]), ("assistant", chat_format.HOSTILE[1])]
    found = {r.conv_id: r for r in chat_format.op2_chat_format(spark, TINY).collect()}
    assert found.keys() == turns.keys()
    for k, v in turns.items():
        said = "".join(t for r, t in v if r == "assistant")
        assert found[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in v).encode()).hexdigest()
        assert (found[k].n_turns, found[k].loss_chars, found[k].loss_sha256) == (len(v), len(said), hashlib.sha256(said.encode()).hexdigest())


HOSTILE_TURNS = [
    ("user", ""), ("assistant", ""), ("assistant", "\\"), ("user", "\\\\### </turn>"), ("a: b\\\n### x", "### user: hi </turn>\n"), ("assistant", "</turn"), ("assistant", "###</turn>###\\"), ("assistant", "#### </turn>\n### assistant: x"),
    ("assistant", "<</turn>"), ("assistant", "ends with space "), ("assistant", "\U0001f600\n\n"), ("", " "), ("assistant", "\\</turn>"), ("assistant", "\\\\###"),
]


def test_rendering_round_trip():
    made = chat_format.format_turns(HOSTILE_TURNS)
    assert chat_format.parse(made.text) == HOSTILE_TURNS
    assert [chat_format.parse(made.text[a:b])[0] for a, b in made.spans] == HOSTILE_TURNS
    assert [chat_format.unescape(made.text[a:b]) for a, b in made.loss] == [t for r, t in HOSTILE_TURNS if r == "assistant"]


def test_round_trip_of_random_texts():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    part = st.text(alphabet="\\#/<>turn assistant:\n \u00e9", max_size=30)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\:b"]), part), max_size=6))
    def check(turns):
        made = chat_format.format_turns(turns)
        assert chat_format.parse(made.text) == turns
        assert [chat_format.unescape(made.text[a:b]) for a, b in made.loss] == [t for r, t in turns if r == "assistant"]

    check()


def test_mask_lies_on_the_text():
    """Texts that are parts of the markup around them, by position, for two templates."""
    markup = ["turn", "t", ">", " ", "/turn>", "turn>", "\n", "</turn>", "assistant", ": ", "###", "", "\ue000", "a\ue001b"]
    for text in markup:
        made = chat_format.format_turns([("user", text), ("assistant", text), ("user", text), ("assistant", text)])
        for k, (a, b) in zip((1, 3), made.loss, strict=True):
            assert a == made.spans[k][0] + len("### assistant: ") and b == made.spans[k][1] - len(" </turn>\n")
            assert chat_format.unescape(made.text[a:b]) == text
    boxed = lambda turns: "<s>" + "".join(f"[{r}]({t.upper()})[/{r}]" for r, t in turns)
    for text in [*markup, "[/assistant]", ")", "("]:
        made = chat_format.format_turns([("assistant", text), ("user", "x"), ("assistant", text)], boxed)
        assert [made.text[a:b] for a, b in made.loss] == [text.upper()] * 2
        assert [a - made.spans[k][0] for k, (a, _) in zip((0, 2), made.loss, strict=True)] == [len("[assistant](")] * 2


def last_only(turns):
    return "".join(f"[{r}]{t if k == len(turns) - 1 else '...'}" for k, (r, t) in enumerate(turns))


def test_template_that_rewrites_history_is_found(spark):
    made = chat_format.format_turns([("user", "a"), ("assistant", "b")], last_only)
    assert (made.rewrites, made.spans, made.loss, made.text) == (1, [], [], "[user]...[assistant]b")
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat_format.format_conversations(df, chat_format.Chat(last_only, None, str), with_text=True).collect()}
    assert (found[1].rewrites_turn, found[1].loss_chars, found[1].turns_sha256, found[1].n_turns) == (1, 0, None, 2)
    assert (found[2].rewrites_turn, found[2].loss_chars, found[2].formatted) == (None, 4, "[assistant]only")
    with pytest.raises(ValueError, match="twice"):
        chat_format.format_turns([("assistant", "b")], lambda turns: "".join(f"{t}|{t};" for _, t in turns))


def test_odd_conversations(spark):
    rows = [(1, 2, "user", "b"), (1, None, None, None), (1, 2, "assistant", "a"), (1, 2, "user", "b"), (None, 1, "user", "x"), (None, 0, "assistant", "y"), (2, 1, "system", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "id": F.lit(2)})
    made = chat_format.format_conversations(df, with_text=True).collect()
    found = {r.conv_id: r for r in made}
    assert chat_format.parse(found[1].formatted) == [("", ""), ("assistant", "a"), ("user", "b"), ("user", "b")]
    assert sorted(chat_format.parse(r.formatted) for r in made if r.conv_id is None) == [[("assistant", "y")], [("user", "x")]]
    assert found[2].loss_chars == 0 and found[2].n_turns == 1
    assert chat_format.format_conversations(df.limit(0)).count() == 0


# Mixing


@pytest.mark.parametrize("cells_in_one_task", [0, 1000])
def test_raking_meets_its_targets(spark, monkeypatch, cells_in_one_task):
    monkeypatch.setattr(mixing, "ONE_TASK", cells_in_one_task)
    cells = [(s, l, t, float(10 * (i + 1) * (j + 2) + 7 * k)) for i, s in enumerate("ab") for j, l in enumerate("xyz") for k, t in enumerate("pq")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double")
    targets = {"source": spark.createDataFrame([("a", 0.8), ("b", 0.2)], "source string, share double"), "lang": spark.createDataFrame([("x", 0.5), ("y", 0.3), ("z", 0.2)], "lang string, share double")}
    fitted = mixing.rake(df, targets, flatten=1.0)
    total = fitted.agg(F.sum("weight")).first()[0]
    for m, want in (("source", {"a": 0.8, "b": 0.2}), ("lang", {"x": 0.5, "y": 0.3, "z": 0.2})):
        have = {r[m]: r.w / total for r in fitted.groupBy(m).agg(F.sum("weight").alias("w")).collect()}
        assert have == pytest.approx(want, abs=1e-6)


def test_raking_warns_where_targets_cannot_be_met(spark):
    df = spark.createDataFrame([("a", "x", "p", 10.0), ("b", "y", "p", 10.0)], "source string, lang string, topic string, tokens double")
    targets = {"source": spark.createDataFrame([("a", 0.8), ("b", 0.2)], "source string, share double"), "lang": spark.createDataFrame([("x", 0.5), ("y", 0.5)], "lang string, share double")}
    with pytest.warns(UserWarning, match="a margin is off"):
        mixing.rake(df, targets, rounds=3)


def test_sampled_tokens_are_as_many_as_asked(spark):
    out = mixing.op1_mixing(spark, "/root/testdata/sf0.01")
    expected, all_, kept, rows = out.agg(F.sum(F.col("n_tokens") * F.col("probability")), F.sum("n_tokens"), F.sum(F.when(F.col("sampled"), F.col("n_tokens")).otherwise(0)), F.count("*")).first()
    assert rows == 1000 and expected / all_ == pytest.approx(mixing.KEEP, abs=1e-4) and kept / all_ == pytest.approx(mixing.KEEP, abs=0.05)


def test_mixing_of_odd_rows(odd, empty):
    found = mixing.mixed(odd).collect()
    assert len(found) == len(odd_rows()) and sorted(map(repr, (r.source for r in found))) == sorted(repr(r[3]) for r in odd_rows())
    assert mixing.mixed(empty).count() == 0
