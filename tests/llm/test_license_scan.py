"""License templates: the automaton against regular expressions, and the query against going word by word."""

import random
import re
from collections import Counter

import pytest
from fixtures import documents, frame

from clearsift.llm.license_scan import BASE, LICENSES, Template, automaton, compile_template, license_places, scan_licenses

NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
ALL = [compile_template(t) for t in BASE + LICENSES]


def plain_words(text):
    return [w for w in NOT_WORD.split((text or "").translate(UPPER)) if w]


def sample(template, rng):
    """A text that the template accepts: regions are left out or filled at random."""
    from clearsift.llm.license_scan import _parse

    def fill(items):
        out = []
        for x in items:
            if isinstance(x, str):
                out.append(x)
            elif isinstance(x, list):
                out += fill(x) if rng.random() < 0.6 else []
            else:
                out += [rng.choice(["acme", "die", "x1", "ünï"]) for _ in range(rng.randint(*x))]
        return out

    return fill(_parse(template))


def brute(doc_id, text):
    w = plain_words(text)
    starts, labels, most = [], set(), 0
    base = set()
    for t in ALL:
        if t.template.base:
            p = t.template.text.split()
            found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += found
            base |= {t.template.label} if found else set()
        if re.search(t.pattern + r"(?: |$)", " " + " ".join(w)):
            labels.add(t.template.label)
            most = max(most, t.n_mandatory)
    return doc_id, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(most / (most + 10), 12)


def got(df):
    return Counter((*r[:7], round(r.score, 12)) for r in df.collect())


def test_every_template_accepts_its_texts_and_no_text_with_another_word():
    rng = random.Random(1)
    machine = automaton()
    for k, t in enumerate(machine.templates):
        for _ in range(20):
            words = sample(t.template, rng)
            assert any(p == (k, 0, len(words)) for p in machine.places(words)), (t.template.label, words)
            run = max(t.mandatory, key=len)
            at = next(i for i in range(len(words)) if tuple(words[i : i + len(run)]) == run)
            assert not any(p[0] == k and p[1] <= at < p[2] for p in machine.places(words[:at] + ["otherwise"] + words[at + 1 :])), t.template.label


def test_equals_expressions_over_words(spark):
    rng = random.Random(2)
    texts = []
    for t in LICENSES * 3:
        words = sample(t, rng)
        if rng.random() < 0.4:
            words[rng.randrange(len(words))] = "otherwise"
        texts.append(" ".join(rng.choice([w, w.upper(), w.capitalize()]) + rng.choice(["", ",", " -", ".\n"]) for w in ["foo"] * rng.randint(0, 3) + words + ["bar"] * rng.randint(0, 3)))
    texts += ["under the MIT License", "CC BY-NC 4.0, cc/by/nc; under the mit license under the mit license", "underthe mit license", "Apache License, Version 2", "apache license version 20", "É" + "under the mit license", "under the mit licenseé"]
    texts += ["lorem " * 20_000 + "Licensed under CC-BY-NC 4.0 " + "ipsum " * 20_000]
    rows = documents() + [(100 + k, x, None, None, None, "clash", -1, 0.5, "clash") for k, x in enumerate(texts)]
    out = got(scan_licenses(frame(spark, rows)))
    assert out == Counter(brute(r[0], r[1]) for r in rows)
    assert {"apache-2", "mit", "gpl", "cc-by-nc"} <= {x for r in out for x in r[6].split(",")}


def test_empty_table_and_clashing_columns(spark):
    assert scan_licenses(frame(spark, [])).count() == 0
    odd = spark.createDataFrame([(1, "under the mit license", 5, "x", "y")], "doc_id long, text string, n_words int, places string, _plain string")
    assert got(scan_licenses(odd)) == Counter([brute(1, "under the mit license")])


def test_places_of_own_templates(spark):
    mine = (Template("own", "take [[and [[do not]] give]] {{what 1 2}} freely"),)
    docs = spark.createDataFrame([(1, "You take and give all of freely; take it freely."), (2, "take freely"), (3, "take and do not give this freely")], "doc_id long, text string")
    out = {r.doc_id: [(p.label, p.first_word, p.end_word) for p in r.places] for r in license_places(docs, mine).collect()}
    assert out == {1: [("own", 1, 7), ("own", 7, 10)], 2: [], 3: [("own", 0, 7)]}


@pytest.mark.parametrize("text", ["[[a b", "a ]] b", "{{x 1 2}} a", "[[a]]"])
def test_malformed_templates_are_refused(text):
    with pytest.raises(ValueError, match="bad"):
        compile_template(Template("bad", text))


def test_the_table_of_moves_is_only_a_cache():
    few, many = automaton(), automaton()
    few.most_states = 3
    words = "this work is licensed under the gnu general public license version 3 all rights reserved under the mit license".split()
    assert few.places(words) == many.places(words)
