import random

import pytest

subjects = pytest.importorskip("waymark.llm.subjects")
DOCS = "doc_id long, text string, agenda_item string, source string, counts string, area int"
TERMS = {"law": ["barristers", "custody hearings", "extradition warrants", "juries"], "energy": ["wind turbines", "heat pumps", "pylons", "the boiler"], "sport": ["referees", "swimming pools", "relay teams", "goalkeepers"]}
FRAMES = ["The report makes 3 recommendations on {}.", "What does the Government intend to do about {}?", "Mr Speaker, spending on {} fell.", "Not one submission defended the present state of {}."]
FORMULAS = ["The jury is still out on that.", "I beg leave to continue.", "This Bill is a train without brakes."]


def make(n=900, seed=1):
    draw = random.Random(seed)
    data, truth = [], []
    for i in range(n):
        about = draw.sample(sorted(TERMS), draw.choice([0, 1, 1, 1, 2]))
        said = [draw.choice(FRAMES).format(draw.choice(TERMS[a])) for a in about for _ in range(draw.choice([3, 5]))]
        other = draw.choice(sorted(TERMS.keys() - set(about)))
        said += [draw.choice(FRAMES).format(draw.choice(TERMS[other]))] * (draw.random() < 0.4) + draw.sample(FORMULAS, 2)
        draw.shuffle(said)
        aside = draw.choice(sorted(TERMS.keys() - set(about)))
        said.insert(1, f'(Mr X: "What about {draw.choice(TERMS[aside])}? And {draw.choice(TERMS[aside])}?") [{draw.choice(TERMS[aside])}.]')
        data.append((i, " ".join(said), draw.choice(["Petitions", "Estimates", None]), draw.choice(["a", "b", None]), "x", 1))
        truth += [(i, a) for a in about]
    return data, truth


def test_sentences_leave_interruptions_out():
    text = 'Sir, I agree. (Mrs X: "You never (ever) cared about tractors!") An Hon. Member: Shame! [Laughter.] We­shall﻿ see about ﬁnance\n\nNo'
    assert subjects.sentences(text) == [["sir", "i", "agree"], ["weshall", "see", "about", "finance"], ["no"]]
    assert subjects.sentences("") == [] and subjects.sentences(" \n. !") == [] and len(subjects.sentences("a. " * 50_000)) == 50_000


def test_held_out_documents(spark):
    data, truth = make()
    labelled = range(0, 900, 3)
    labels = [(i, a) for i, a in truth if i in labelled] + [(i, "none") for i in labelled if i not in {d for d, _ in truth}] + [(3, "unknown area"), (99999, "law"), (None, "law")]
    documents, known = spark.createDataFrame(data, DOCS), spark.createDataFrame(labels, "doc_id long, subject string")
    got = {tuple(r) for r in subjects.assigned(documents, known, sorted(TERMS)).collect()}
    want = set(truth)
    held = lambda pairs: {p for p in pairs if p[0] not in labelled}
    right = len(held(got) & held(want))
    assert right / len(held(got)) > 0.97 and right / len(held(want)) > 0.97
    both = len(got & want)
    assert both / len(got) > 0.97 and both / len(want) > 0.97


def test_unusual_tables(spark):
    data, truth = make(60)
    documents = spark.createDataFrame([*data, (100, None, None, None, None, None), (101, "", "x", "y", None, None), (None, "juries", None, None, None, None), data[0]], DOCS)
    labels = spark.createDataFrame([(i, a) for i, a in truth], "doc_id long, subject string")
    got = subjects.assigned(documents, labels, sorted(TERMS))
    assert got.where("doc_id is null or doc_id >= 100").count() == 0 and got.groupBy("doc_id", "subject").count().where("count > 1").count() == 0
    assert subjects.assigned(documents, labels.where("false"), sorted(TERMS)).count() == 0
    assert subjects.assigned(documents.where("false"), labels, sorted(TERMS)).count() == 0
    areas = spark.createDataFrame([(a,) for a in TERMS], "subject string")
    assert subjects.composition(got, documents, areas).count() == 3 and subjects.composition(got.where("false"), documents.where("false"), areas).agg({"share": "max"}).first()[0] == 0.0


def test_posteriors_learn_which_function_to_trust():
    code = lambda lex, address, section, source: ((lex * 3 + address) * 3 + section) * 3 + source
    free = {code(0, 1, 1, 1): 8000, code(1, 1, 1, 1): 900, code(4, 1, 1, 1): 1000, code(2, 2, 1, 1): 50, code(2, 0, 1, 1): 60, code(5, 2, 1, 1): 500, code(1, 0, 1, 1): 400, code(0, 0, 1, 1): 400}
    table = subjects.posteriors(free, {code(4, 1, 1, 1): 90, code(3, 1, 1, 1): 9, code(2, 1, 1, 1): 1}, {code(0, 1, 1, 1): 800, code(1, 1, 1, 1): 90, code(2, 1, 1, 1): 1})
    assert table[code(4, 1, 1, 1)] > 0.9 and table[code(1, 1, 1, 1)] < 0.1 and table[code(0, 1, 1, 1)] < 0.1
    assert table[code(2, 2, 1, 1)] > 0.9 and table[code(2, 0, 1, 1)] < 0.1  # what the labels didn't show: the address decides
    assert subjects.posteriors({}, {}, {}) == {} and subjects.posteriors(free, {}, {}) == {}


def test_growth_finds_terms_that_no_label_shows(spark):
    data, truth = make(2000, seed=3)
    known = {"law": "barristers", "energy": "pylons", "sport": "referees"}
    spoken = spark.createDataFrame([(d[0], "\n".join(map(" ".join, subjects.sentences(d[1])))) for d in data], "doc_id long, spoken string")
    seeds = {w: (i, 0.9) for i, w in enumerate(known.values())}
    grown = subjects.grown_lexicon(spoken, spark.createDataFrame([], "doc_id long, mask int"), seeds, 3)
    assert all(grown[t][0] == i for i, a in enumerate(known) for t in TERMS[a][1:] if t in grown)
    assert sum(t in grown for terms in TERMS.values() for t in terms) >= 9 and "government" not in grown


def test_other_documents_at_an_address_vote(spark):
    counts = [(1, "x", "s", "a", [5, 0]), (2, "x", "s", "a", [2, 0]), (3, "x", "s", "b", [0, 3]), (4, "x", "s", None, [0, 0]), (5, "x", "s", None, [0, 0])]
    df = spark.createDataFrame(counts, "doc_id long, section string, source string, address string, counts array<int>")
    import numpy as np

    got = {r.doc_id: [int(np.unravel_index(p, subjects._BINS)[1]) for p in r.patterns] for r in subjects.vote_patterns(df, 2).collect()}
    assert got == {1: [0, 0], 2: [2, 0], 3: [1, 1], 4: [1, 1], 5: [1, 1]}


def test_long_and_deep_interruptions_are_cut_out():
    said = [["we", "tax"], ["we", "spend"]]
    assert subjects.sentences("We tax. (" + "Fish is cheap. " * 60 + ") We spend.") == said
    assert subjects.sentences("We tax. (a [b (c (d) e) f] g) We spend.") == said
