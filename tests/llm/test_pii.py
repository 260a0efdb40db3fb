"""Personal data: the contract's patterns on random texts, planted disguises, hostile texts, whole tables."""

import hashlib
import re
import time

import numpy as np
import pytest

from sessionloom.llm import pii

RNG = np.random.default_rng(11)
PLAIN = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def plain(text):
    return {k: [m.span() for m in shape.finditer(text) if ok(m.group())] for k, (shape, ok) in PLAIN.items()}


@pytest.mark.parametrize("letters", ["0123456789.", "01.", "4 0-", "+12 ().-", "a1@.- +", "0123456789 -"])
def test_base_spans_are_the_patterns(letters):
    for n in (5, 20, 60, 200):
        for _ in range(60):
            t = "".join(RNG.choice(list(letters), n))
            assert pii.detect(t) == plain(t), t


@pytest.mark.parametrize(
    "text",
    ["one two, " + "1" * 40 + "x", "one two, " + "1" * 1_000_000 + "x", "1" * 1_000_000, "1." * 500_000, "one " * 200_000 + "x", "a_dot_" * 60 + " [at] b", "+1" + "(" * 1_000_000, "4 " * 500_000, "a" * 500_000 + "@" * 1000, "one two three" + " 1" * 300_000 + "x"],
)
def test_hostile_texts_end(text):
    began = time.process_time()
    pii.find(text)
    assert time.process_time() - began < 6


def test_a_megabyte_of_digits_is_quick():
    began = time.process_time()
    pii.find("7" * 1_000_000)
    assert time.process_time() - began < 1


def test_planted_disguises_of_all_kinds_are_added():
    card = "4539148803436467"
    words = dict(zip("0123456789", "zero one two three four five six seven eight nine".split(), strict=True))
    spell = lambda s: " ".join(words.get(c, "plus" if c == "+" else c) for c in s)
    texts = {
        "email": ["mail ann at mail dot example dot org now", "ann [at] example [dot] org", "ann_at_example_dot_org", "ann@ex\u0430mple\u2024org", "ann (at) example.org"],
        "ip": ["host 10 dot 0 dot 255 dot 1 up", "10[.]0[.]255[.]1", "\uff11\uff10.0.255.1"],
        "card": [f"card {spell(card)} ok", f"card {spell(card[:4])} {card[4:]}", "".join(chr(0xFF10 + int(c)) for c in card)],
        "phone": [f"call {spell('+14155552671')} now", "call plus 1 415 555 2671", "+1 415 five five five 2671"],
    }
    for kind, some in texts.items():
        for t in some:
            own, more = pii.find(t)
            assert len(own[kind]) == 0 and len(more[kind]) == 1, (kind, t)


def test_personal_data(spark):
    texts = ["a.b@c.de and 10.0.0.1", "", None, "john at example dot com", "x " * 100_000 + "a@b.cd", "\U0001f600 a@b.cd"]
    rows = [(i, t, 1, "n") for i, t in enumerate(texts)]
    d = spark.createDataFrame([*rows, rows[0], (None, "a@b.cd", 2, "m")], "doc_id long, text string, n_email int, spans string")
    got = pii.personal_data(d).collect()
    assert len(got) == len(rows) + 2 and sum(r.doc_id == 0 for r in got) == 2
    for r in got:
        t = "a@b.cd" if r.doc_id is None else texts[r.doc_id] or ""
        want = plain(t)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k]).encode()).hexdigest()
    by = {r.doc_id: r for r in got}
    assert by[3].spans == "email:0:23" and by[3].n_added == 1 and by[5].spans == "email:2:8" and by[1].spans == by[2].spans == ""
    assert pii.personal_data(d.limit(0)).count() == 0
