import re

from veilspark.llm.licenses import _GATE, _UNDER, BASE_RULES, RULES, scan_licenses

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(text):
    words = WORD.findall((text or "").translate(LOW))
    places = [(i, r.label) for r in BASE_RULES for i in range(len(words)) if words[i : i + len(r.pattern.split())] == r.pattern.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


TEXTS = [
    "All rights reserved. ALL RIGHTS RESERVED by x. cc-by cc by CC  BY-NC-SA 4.0",
    "Licensed under the Apache License, Version 2.0 (see)",
    "SPDX-License-Identifier: MIT",
    "This is under GNU General Public License v3 or later, python ruby php boost",
    None, "", "   ", "é cc byK cc by K lİcense", "released under MIT", "mit der Zeit",
    "the MIT license; Mozilla Public License 2.0; " + "all rights reserved " * 700,
]


def test_base_places_and_labels(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), i
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    labels = {i: r.labels for i, r in got.items()}
    assert labels[0] == "cc-by,cc-by-nc-sa-4.0,reserved"
    assert labels[1] == "apache-2.0" and labels[2] == "mit" and labels[3] == "gpl,gpl-3.0"
    assert labels[8] == "mit" and labels[9] == ""
    assert got[2].score == 1.0 and got[5].score == 0.0
    spans = [s for s in got[0].spans if s.label == "cc-by-nc-sa-4.0"]
    assert [(s.start, s.end) for s in spans] == [(12, 18)]


def test_rules_are_gated_by_their_keyword():
    assert len(RULES) > 300
    for rule in RULES:
        assert re.compile(rule.pattern) and rule.keyword == rule.keyword.lower()


def test_odd_rows(odd_docs, no_docs):
    got = scan_licenses(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r.labels == "" for r in got)
    assert {r.n_words for r in got if r.doc_id == 7} == {60_000}
    assert scan_licenses(no_docs).count() == 0


def spelled(parsed):
    """Every text that a parsed pattern matches, a repeat taken least and most often, a class by its first members."""
    found = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = ["7" if str(a[0]) == "CATEGORY" else chr(a[1] if str(a[0]) == "LITERAL" else a[1][0]) for a in arg]
        elif name == "BRANCH":
            more = [text for branch in arg[1] for text in spelled(branch)]
        elif name == "SUBPATTERN":
            more = spelled(arg[3])
        else:
            assert name == "MAX_REPEAT", name
            more = [text * n for n in {arg[0], min(arg[1], arg[0] + 1)} for text in spelled(arg[2])]
        found = [a + b for a in found for b in dict.fromkeys(more)]
    return found


def test_keyword_and_gate_stand_in_all_that_a_rule_matches():
    for rule in RULES:
        pattern = rule.pattern.replace(_UNDER, "licensed under the ")
        for text in spelled(re._parser.parse(pattern)):
            assert re.fullmatch(pattern, text)
            assert rule.keyword in f" {text} " and re.search(_GATE, text), (rule, text)


def test_names_without_the_family_word(spark):
    texts = {
        "Do What The Fuck You Want To Public License": "wtfpl",
        "licensed under the Expat License": "mit",
        "the Expat license": "mit",
        "released under the Simplified License": "bsd-2-clause",
        "a two-clause license": "bsd-2-clause",
        "WTFPL license": "wtfpl",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert [got[i].labels for i in range(len(texts))] == list(texts.values())
    assert all(r.score > 0 for r in got.values())
