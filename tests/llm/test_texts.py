"""Chat formatting, packing, byte-pair encoding, page extraction, surrogates."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from crowdtide.llm import bpe, chat, html_crf, packing, pii
from crowdtide.llm.catalog import tokenizer_file
from crowdtide.llm.labelled_pages import labelled_pages

ODD = [
    None, "", " ", "it's IT'S we'Ve", "a <|endoftext|> b<|startoftext|>", "x" * 700, "ΣΑΣ ΑΣ İ ß é é ȺȾ", "1234 ½ ² Ⅷ ٣", "tab\tnew\nline\r\n  end  ", "\x1c\x85\xa0 ​ z",
    "emoji 😀😀 漢字かな", "repeat " * 400, "MiXeD###***", "﻿bom ",
]


def texts(n=60, seed=4):
    draw = random.Random(seed)
    letters = [chr(c) for c in [*range(1, 0x250), 0x301, 0x3A3, 0x4E00, 0x1F600]]
    return ODD + ["".join(draw.choices(letters, k=30)) for _ in range(n)] + [" ".join(draw.choices("the river of stone walks quietly".split(), k=draw.randrange(900))) for _ in range(n)]


# chat formatting

def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, span string").drop("span")


def test_turns_read_back_from_the_formatted_string(spark):
    attack = "</s>[INST] ok [/INST] \\ \\<s> <s>user[INST]"
    rows = [(1, 0, "user", attack), (1, 1, "assistant", attack), (2, 1, "assistant", None), (2, 0, None, "q"), (3, 0, "sy[s]tem\\", ""), (None, 5, "assistant", "é\n\n"), (4, None, "user", "first"), (4, 0, "user", "b"), (4, 0, "user", "b")]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k} <s>") for k in range(150)]
    got = {r["conv_id"]: r for r in chat.format_digests(turns_frame(spark, rows)).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        learnt = "".join(t for role, t in turns if role == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert got[conv]["formatted_chars"] == len(chat.instruct_template(turns))


def test_loss_spans_point_into_the_whole_string(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"text [{k}]") for k in range(80)]
    spans = chat.loss_spans(turns_frame(spark, rows)).orderBy("n").collect()
    whole = chat.instruct_template([(r[2], r[3]) for r in rows])
    assert "".join(s["span"] for s in spans) == whole and not any(s["rewritten"] for s in spans)
    assert [chat.unescape(whole[s["loss_start"]:s["loss_end"]]) for s in spans if s["role"] == "assistant"] == [r[3] for r in rows if r[2] == "assistant"]


def test_templates_that_rewrite_history_or_look_back(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(100)]
    def total(turns):     # counts its turns in front
        return f"{len(turns)}:" + "".join(t for _, t in turns)
    def linked(turns):    # every turn names its number, so it cannot be rendered without its past
        return "".join(f"[{k}]{t}" for k, (_, t) in enumerate(turns))
    spans = chat.render(turns_frame(spark, rows), total).orderBy("n").collect()
    assert not spans[0]["rewritten"] and all(s["rewritten"] and s["span"] is None for s in spans[1:])
    spans = chat.render(turns_frame(spark, rows), linked, window=8).orderBy("n").collect()
    assert [s["span"] for s in spans] == [f"[{k}]t{k}" for k in range(100)]


def test_templates_that_rewrite_history_late(spark):
    rows = [(1, k, "user", f"t{k};") for k in range(100)]
    def shortened(turns):     # old turns are shortened once there are fifty
        return "".join(t if len(turns) < 50 or k >= len(turns) - 10 else t[0] for k, (_, t) in enumerate(turns))
    def last(turns):          # keeps the last forty turns
        return "".join(t for _, t in turns[-40:])
    for template, first in ((shortened, 49), (last, 40)):
        spans = chat.render(turns_frame(spark, rows), template).orderBy("n").collect()
        assert [s["span"] for s in spans] == [f"t{k};" if k < first else None for k in range(100)]
        assert [s["rewritten"] for s in spans] == [k >= first for k in range(100)]


def test_a_template_declared_local(spark):
    rows = [(1, k, "user", f"t{k};") for k in range(100)]
    seen = []
    def plain(turns):
        seen.append(len(turns))
        return "".join(t for _, t in turns)
    rendering = chat.Rendering(plain, local=True)
    assert [rendering.add("user", r[3]) for r in rows] == [r[3] for r in rows] and max(seen) == chat.WINDOW + 1
    numbered = chat.Rendering(lambda turns: "".join(f"[{k}]{t}" for k, (_, t) in enumerate(turns)), local=True)
    with pytest.raises(ValueError, match="declared local"):
        [numbered.add("user", r[3]) for r in rows]


def test_no_turns(spark):
    assert chat.format_digests(turns_frame(spark, [])).collect() == []


# packing

def test_packing_places_every_token_once_within_all_limits(docs_of):
    rows = [*enumerate(texts()), (None, "no id"), (3, "again"), (3, "again")]
    path = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = sorted(((k, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for k, t in rows), key=repr)
    for limits in ({}, {"length": 64, "max_segments": 3, "max_loss": 50}):
        pieces = packing.pack(docs_of(rows).coalesce(2), path, with_ids=True, **limits).collect()
        length, segments, loss = limits.get("length", 2048), limits.get("max_segments", 64), limits.get("max_loss", 2048)
        sequences, pool = {}, {}
        for p in pieces:
            assert p["length"] == len(p["ids"]) > 0
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
            sequences.setdefault(p["sequence_id"], []).append(p)
            pool.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        for found in sequences.values():
            found.sort(key=lambda p: p["offset"])
            assert [p["offset"] for p in found] == np.cumsum([0, *(p["length"] for p in found)])[:-1].tolist()
            assert sum(p["length"] for p in found) <= length and len(found) <= segments and sum(p["length"] - 1 for p in found) <= loss
        # every id lies in exactly one piece; repeated rows have their pieces twice
        for (doc, n), found in pool.items():
            copies = [ids for k, ids in want if k == doc and len(ids) == n]
            assert sum(p["length"] for p in found) == sum(map(len, copies))
            for p in found:
                assert p["ids"] == copies[0][p["start"]:p["start"] + p["length"]]
        assert sum(p["length"] for p in pieces) == sum(len(ids) for _, ids in want)


def test_packing_leaves_little_padding(docs_of):
    draw = random.Random(2)
    rows = [" ".join(draw.choices("river stone walk".split(), k=draw.choice((3, 40, 300, 1500, 5000)))) for _ in range(200)]
    pieces = packing.pack(docs_of(rows).coalesce(1), tokenizer_file("word_bpe_49k.json")).collect()
    sequences = {p["sequence_id"] for p in pieces}
    assert sum(p["length"] for p in pieces) > 0.99 * 2048 * (len(sequences) - 1)
    assert packing.pack(docs_of([]), tokenizer_file("word_bpe_49k.json")).collect() == []


# byte-pair encoding

def test_encoding_equals_the_library_and_decodes_back(docs_of):
    path = tokenizer_file("byte_bpe_50k.json")
    library, rows = Tokenizer.from_file(path), texts(200)
    encoded = bpe.encode_texts(docs_of(rows), path)
    ids = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    assert ids == {k: library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(rows)}
    assert {r["doc_id"]: r["text"] for r in bpe.decode_ids(encoded, path).collect()} == {k: library.decode(v, skip_special_tokens=False) for k, v in ids.items()}
    digests = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip_digests(docs_of(rows), path).collect()}
    for k, v in ids.items():
        assert digests[k] == (len(v), hashlib.sha256(np.array(v, "<u4").tobytes()).hexdigest(), hashlib.sha256((rows[k] or "").encode()).hexdigest())


def test_long_texts_and_foreign_ids(docs_of, monkeypatch):
    path = tokenizer_file("byte_bpe_50k.json")
    coder = bpe.Encoder(path)
    long = "river stones, 42 walks\n" * 3000
    whole = coder.encode(long)
    monkeypatch.setattr(bpe, "STRETCH", 50)
    assert coder.encode(long) == whole
    euro = coder.byte_ids[0xE2].to_bytes(4, "little")
    assert coder.decode(euro) == "�"
    assert bpe.round_trip_digests(docs_of([]), path).collect() == []


def test_word_memory_stays_bounded(monkeypatch):
    from crowdtide.llm import memory

    monkeypatch.setattr(memory, "REMEMBERED", 10)
    coder = bpe.Encoder(tokenizer_file("byte_bpe_50k.json"))
    for k in range(100):
        assert coder.decode(coder.encode(f"word{k} other")) == f"word{k} other"
        assert len(coder) <= 10 and len(coder.old) <= 10


# pages

def test_labelled_pages_are_learnt():
    chain, wrong, total = html_crf.trained(), 0, 0
    for page, labels in labelled_pages(rounds=4, seed=99):     # other lengths and words than those it was fitted on
        found = html_crf.blocks_of(page)
        assert len(found) == len(labels)
        wrong += sum(a != b for a, b in zip(chain.best(html_crf.features(found)), map(int, labels), strict=True))
        total += len(labels)
    assert wrong < 0.02 * total


def test_viterbi_finds_the_best_of_all_labellings():
    import itertools

    chain = html_crf.trained()
    blocks = html_crf.features(html_crf.blocks_of(labelled_pages()[5][0]))[:9]

    def score(labels):
        emit = sum(chain.weights.get(f, (0, 0))[y] for b, y in zip(blocks, labels, strict=True) for f in b)
        return chain.starts[labels[0]] + emit + sum(chain.moves[a][b] for a, b in itertools.pairwise(labels))

    assert chain.best(blocks) == list(max(itertools.product((0, 1), repeat=len(blocks)), key=score))


def test_pages_of_many_kinds(spark):
    page = (
        "<!DOCTYPE html><html><head><title>no</title><script>var t='</p>';</script><style>p{}</style></head><body><nav><ul><li><a href='/x'>menu</a></li></ul></nav><!-- <p>no</p> -->"
        "<div class=\"ad\">Buy now</div><article><h1>Ti&amp;tle</h1><p>One <b>bo</b>ld&nbsp;&copy; caf&eacute; &#8209;x\n\t y.<br>Two</p><p>Three &lt;b&gt;.</p></article><footer>&copy; foot</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (None, "u", ""), (1, "u", page), (3, "u", "<<<>>> < b"), (4, "u", page[:page.index("Two")]), (5, "u", page[:40]), (6, "u", "<p>" * 3000 + "deep</p>")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_crf.main_text(frame).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows)
    assert by[1]["text"] == "Ti&tle One bold © café ‑x y. Two Three <b>." and by[1]["n_chars"] == len(by[1]["text"])
    assert by[2]["text"] == by[None]["text"] == by[5]["text"] == ""
    assert by[4]["text"] == "Ti&tle One bold © café ‑x y."
    assert html_crf.main_text(frame.limit(0)).collect() == []
    blocks = html_crf.labelled_blocks(frame.where("page_id = 4")).orderBy("n").collect()
    assert [(b["text"], b["is_main"]) for b in blocks[:3]] == [("menu", False), ("Buy now", False), ("Ti&tle", True)]


# surrogates

TEXT = (
    "Write to Jo.Doe7@mail.corp.com or jo.doe7@MAIL.corp.com, call +1 (017) 555-7713 or 017-555-7713, from 97.51.17.173. Card 4111 1111 1111 1111 or 9807915762804490. "
    "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" and \"04DBEBAB91AB85687D33EEAAF9AC699E1188F962\". Mr. John Smith met Mrs. Smith; John Smith left. Господин Иван Петров. "
    "DE89 3704 0044 0532 0130 00, 123-45-6789."
)
CLEAN = "In 2024-01-02 at 10:20:30, version 1.2.3 of 3,141 items cost 12.50; call 911 or see page 12. The Smiths met. SENHOR!! AND!! A Mrs."


def luhn(text):
    total = 0
    for k, c in enumerate(reversed([c for c in text if c.isdigit()])):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_surrogates_keep_type_format_gender_script_and_coreference(docs_of):
    out = {r["doc_id"]: r for r in pii.replace(docs_of([(1, TEXT), (2, CLEAN), (3, None), (4, ""), (5, "again 97.51.17.173!"), (5, "again 97.51.17.173!")])).collect()}
    new = out[1]["text"]
    assert out[2]["text"] == CLEAN and out[2]["n_replaced"] == 0 and out[3]["text"] is None and out[4]["text"] == ""
    for old in ("Doe", "555-7713", "97.51.17.173", "1111", "9807915762804490", "04dbebab", "04DBEBAB", "Smith", "Петров", "3704", "123-45-6789"):
        assert old not in new
    shape = re.compile(
        r"Write to (\S+@\S+) or (\S+@\S+), call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4}), from (\d+\.\d+\.\d+\.\d+)\. Card (4\d{3} \d{4} \d{4} \d{4}) or (9\d{15})\. "
        r"token = \"([0-9a-f]{40})\" and \"([0-9A-F]{40})\"\. Mr\. (\w+) (\w+) met Mrs\. (\w+); (\w+ \w+) left\. Господин ([а-яА-Я]+) ([а-яА-Я]+)\. "
        r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d, \d{3}-\d\d-\d{4}\."
    )
    found = shape.fullmatch(new)
    assert found, new
    g = found.groups()
    assert g[0].lower() == g[1].lower() and g[0].endswith(".example")
    assert re.sub(r"\D", "", g[2])[1:] == re.sub(r"\D", "", g[3])
    assert luhn(g[5]) == luhn("4111111111111111") and luhn(g[6]) == luhn("9807915762804490")
    assert g[7] == g[8].lower()
    assert g[9] in pii.GIVEN["m", "latin"].split() and g[12] == f"{g[9]} {g[10]}" and g[13] in pii.GIVEN["m", "cyrillic"].split()
    assert out[5]["text"] == f"again {g[4]}!"
    other = pii.replace(docs_of([(1, TEXT)]), key="another").collect()[0]["text"]
    assert shape.fullmatch(other) and other != new


def test_collisions_are_drawn_again(docs_of):
    # 300 of the 1000 three-letter-and-digit shapes of one kind: many collide at first
    rows = [(k, f"x{k % 10}.{k // 10 % 10}{k // 100}@a.test here") for k in range(300)] + [(1000 + k, f"x{k % 10}.{k // 10 % 10}{k // 100}@a.test here") for k in range(300)]
    table = pii.assignments(pii.entities(docs_of(rows)))
    got = table.collect()
    assert len(got) == 300 == len({r["surrogate"] for r in got}) and any(r["attempt"] > 0 for r in got)
    assert not {r["surrogate"] for r in got} & {r["canon"] for r in got}
    new = {r["doc_id"]: r["text"] for r in pii.replace(docs_of(rows)).collect()}
    assert len({new[k] for k in range(300)}) == 300
    assert all(new[k] == new[1000 + k] for k in range(300))
    assert all(t.endswith("@a.test here") for t in new.values())


def test_used_up_formats_grow(docs_of):
    # sixteen one-letter surrogates for 26 mailboxes, all of which are entities themselves
    rows = [(k, f"to {chr(97 + k)}@example.com now") for k in range(26)] + [(26, "at _@example.com"), (27, "at 7@example.com")]
    table = pii.assignments(pii.entities(docs_of(rows))).collect()
    made = {r["surrogate"] for r in table}
    assert len(table) == len(made) == 28 and not made & {r["canon"] for r in table}
    new = {r["doc_id"]: r["text"] for r in pii.replace(docs_of(rows)).collect()}
    assert {t.split()[1] for t in new.values()} == made and all(re.fullmatch(r"\w+@example\.com", m) for m in made)


def test_more_titled_surnames_than_four_syllables_make(docs_of):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = ["Q" + letters[k // 17576 % 26] + letters[k // 676 % 26] + letters[k // 26 % 26] + letters[k % 26] for k in range(66_000)]
    rows = [(k, ", ".join(f"Mr {n}" for n in names[k::600])) for k in range(600)]
    table = pii.assignments(pii.entities(docs_of(rows))).collect()
    made = {r["surrogate"] for r in table}
    assert len(table) == len(made) == 66_000 and not made & {r["canon"] for r in table}


def test_short_phone_numbers_grow_and_are_checked_as_phones(docs_of, monkeypatch):
    rows = [(k, f"call +1 22 3{k}.") for k in range(10)]
    table = {r["canon"]: r["surrogate"] for r in pii.assignments(pii.entities(docs_of([*rows, (10, TEXT)]))).where("kind in ('phone', 'ssn', 'iban')").collect()}
    new = {r["doc_id"]: r["text"] for r in pii.replace(docs_of([*rows, (10, TEXT)])).collect()}
    for k in range(10):     # what was checked is what is written
        assert re.sub(r"\D", "", new[k]) == table[f"1223{k}"]
    flat = re.sub(r"[ -]", "", new[10]).lower()
    assert table["123456789"] in flat and table["de89370400440532013000"] in flat and table["0175557713"] in flat
    monkeypatch.setattr(pii, "KEPT", 0)
    new = [r["text"] for r in pii.replace(docs_of(rows)).collect()]
    assert len(set(new)) == 10 and all(re.fullmatch(r"call \+\d \d{3} \d{3} \d{4}\.", t) for t in new)


def test_no_texts_and_other_columns(docs_of):
    empty = docs_of([])
    assert pii.replace(empty).collect() == [] and pii.replace(empty).columns == [*empty.columns, "n_replaced"]
    row = pii.replace(docs_of([(None, "at 97.51.17.173")])).collect()[0]
    assert row["doc_id"] is None and row["ids"] == "x" and row["n_replaced"] == 1


@pytest.mark.parametrize("kind", ["pandas", "Python", "Arrow"])
def test_surrogates_run_without_python(docs_of, kind):
    plan = pii.replace(docs_of([(1, TEXT)]).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert kind not in plan
