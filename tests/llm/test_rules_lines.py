"""Quality ledger, line deduplication and exact duplicates."""

import hashlib
import re

from pyspark.sql import functions as F

from crowdtide.llm import exact_dedup, line_dedup, quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{k}" for k in range(60))
TEXTS = [
    None, "", "  \n\t ", "a a a a a a", "x\nx\n\nx \n x\n", LONG, LONG + "\n" + LONG, "### " * 30 + LONG, "ÄÖ é #|<> %", "one\rtwo\x0bthree", "a b c a b c d\nq",
    "\n".join(["same line here"] * 90), "WORD!! " * 70, "é" * 3000, "tail\n", "\n\n", "a" + "\n" * 5 + "a",
]


def measured(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    trios = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, t in enumerate(trios) if trios.count(t) > 1 for j in range(3)}
    upper = [w for w in words if len(re.findall("[A-Z]", w)) >= 2 and not re.search("[a-z]", w)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered), len(upper)


def test_measures_equal_plain_python(docs_of):
    got = {r["doc_id"]: tuple(r[m] for m in quality_rules.MEASURES) for r in quality_rules.ledger(docs_of(TEXTS)).collect()}
    assert got == {k: measured(t) for k, t in enumerate(TEXTS)}


def test_bits_policies_and_ablation(docs_of):
    book = quality_rules.ledger(docs_of(TEXTS)).cache()
    rows = book.collect()
    for r in rows:
        assert bool(r["fail_mask"] & quality_rules.BITS["few_words"]) == (r["n_words"] < 50)
        assert bool(r["fail_mask"] & quality_rules.BITS["repeated_words"]) == (100 * r["n_repeat_words"] > 50 * r["n_words"])
    for version, rules in quality_rules.POLICIES.items():
        mask = quality_rules.policy_mask(rules)
        kept = {r["doc_id"] for r in book.where(quality_rules.verdict(F.col("fail_mask"), version)).collect()}
        assert kept == {r["doc_id"] for r in rows if not r["fail_mask"] & mask}
        for a in quality_rules.ablation(book, version).collect():
            bit = quality_rules.BITS[a["rule"]]
            assert a["n_failed"] == sum(bool(r["fail_mask"] & bit) for r in rows)
            assert a["n_only"] == sum(r["fail_mask"] & mask == bit for r in rows)
            assert a["n_documents"] == len(rows)


def test_ledger_of_repeated_null_and_no_rows(docs_of):
    assert quality_rules.ledger(docs_of([])).collect() == []
    rows = quality_rules.ledger(docs_of([(None, LONG), (1, LONG), (1, LONG)])).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None"] and {r["fail_mask"] for r in rows} == {0}


def test_lines_on_many_pages_of_a_site_go(docs_of):
    rows = [(k, f"Menu \npage {k} of a\n\nunique {k}", "a") for k in range(20)] + [(100 + k, f"Menu\nonly {k}" if k < 2 else f"text {k}", "b") for k in range(30)]
    rows += [(200, None, "a"), (201, "", "a"), (202, "Menu", None), (203, "Menu\nMenu", "a")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_boilerplate(docs_of(rows)).collect()}
    assert got[3] == ("page 3 of a\n\nunique 3", 4, 1)
    assert got[100] == ("Menu\nonly 0", 2, 0)          # 2 of 30 pages, fewer than the least number
    assert got[200] == (None, 0, 0) and got[201] == ("", 1, 0)
    assert got[202] == ("Menu", 1, 0) and got[203] == ("", 2, 2)


def test_ratio_must_be_exceeded_and_repeats_in_a_page_count_once(docs_of):
    rows = [(k, "edge\nedge\nedge" if k < 10 else f"t{k}", "a") for k in range(100)] + [(500 + k, "over" if k < 11 else f"u{k}", "c") for k in range(100)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(docs_of(rows)).collect()}
    assert got[0] == "edge\nedge\nedge" and got[500] == ""


def test_line_dedup_keeps_columns_and_takes_an_empty_table(docs_of):
    empty = docs_of([])
    out = line_dedup.drop_boilerplate(empty)
    assert out.collect() == [] and out.columns == [*empty.columns, "n_lines", "n_dropped"]


def test_exact_groups(docs_of):
    big = "Long text " * 20_000
    rows = [(1, "Same"), (2, "sAME"), (3, "same "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, big), (9, big.lower()), (9, big), (None, "same"), (10, "alone")]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs_of(rows)).collect()), key=repr)
    assert got == sorted([
        (1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True), (7, 7, 1, True),
        (8, 9, 3, False), (9, 9, 3, True), (9, 9, 3, True), (10, 10, 1, True),
    ], key=repr)
    digests = {r["doc_id"]: r["text_sha256"] for r in exact_dedup.exact_groups(docs_of(rows)).collect()}
    assert digests[1] == hashlib.sha256(b"same").hexdigest() and digests[4] == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.exact_groups(docs_of([])).collect() == []


def test_quotient_filters_merge_without_loss():
    import numpy as np

    values = np.random.default_rng(1).integers(0, 1 << 64, 500, dtype=np.uint64)
    stream = np.concatenate([values, values[:200], values[:50]])
    whole = exact_dedup.QuotientFilter(4)
    for part in np.array_split(stream, 7):
        piece = exact_dedup.QuotientFilter(4)
        piece.add(part)
        for quotient, run in piece.slots.items():
            whole.merge(quotient, *run)
    assert sum(int(c.sum()) for _, c in whole.slots.values()) == len(stream)
    assert sorted(np.concatenate([whole.repeated(q) for q in whole.slots]).tolist()) == sorted(values[:200].tolist())


def test_fingerprint_collisions_are_told_apart_by_bytes(docs_of, monkeypatch, spark):
    # all texts as suspects: the byte comparison alone must still give the same groups
    monkeypatch.setattr(exact_dedup, "repeated_fingerprints", lambda prints, rows: prints.select("fp").distinct())
    rows = [(1, "a"), (2, "A"), (3, "b")]
    got = sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(docs_of(rows)).collect())
    assert got == [(1, 2, False), (2, 2, True), (3, 3, True)]
