import random
import re
from math import comb

import pytest

from chatterloom.llm.components import components
from chatterloom.llm.jaccard import JaccardConfig, deduplicate, least_matches, near_duplicate_classes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    ws = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    n = min(5, len(ws))
    return frozenset(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)) if ws else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    near = [
        [j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        for i in range(len(rows))
    ]
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        same = [rows[j][0] for j in range(len(rows)) if (j == i or sets[i]) and sets[j] == sets[i] and rows[j][0] is not None and (sets[i] or j == i)]
        out.append((key, min(ids, default=None), min(same, default=None), len(near[i])))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    vocabulary = [f"{a}{b}ö" for a in "abcdefgh" for b in "klmnopqr"]
    rows, key = [], 0
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(60 + group * 40)]
        for copy in range(rng.choice([1, 2, 5, 25])):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = "changed"
            rows.append((key, " ".join(words)))
            key += 1
    rows += [(500, None), (501, ""), (502, "!!"), (503, "two words"), (504, "Two, WORDS."), (505, "two words more")]
    rows += [rows[0], rows[3], (None, "null key text of exactly eight words here"), (None, "null key text of exactly eight words here")]
    rows += [(600, "long " + " ".join(vocabulary * 300)), (601, " ".join(vocabulary * 300)), (5, "an id with two texts of its own kind")]
    return rows


@pytest.mark.parametrize("blocks", [1024, 7], ids=["whole", "cut"])
def test_equals_brute_force(spark, blocks):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicate_classes(docs, config=JaccardConfig(block_nodes=blocks))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_deduplicate_keeps_one_of_each_class(spark):
    rows = [(k, t, "x") for k, t in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    kept = deduplicate(docs)
    assert kept.columns == docs.columns
    want = {(k, t) for (k, t), (_, c, _, _) in zip(sorted(corpus(), key=repr), brute(corpus())) if k == c}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got))
    classes = {c for k, c, _, _ in brute(corpus())}
    assert {k for k, _ in got} == classes and {k for k, _ in got} == {k for k, _ in want}


def test_empty_and_linkless(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicate_classes(none).count() == 0 and deduplicate(none).count() == 0
    alone = spark.createDataFrame([(1, "one text of more than five words"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicate_classes(alone).collect())) == [(1, 1, 1, 0), (2, 2, 2, 0)]


def test_least_matches_grow():
    needed = least_matches(JaccardConfig())
    assert needed == sorted(needed) and 3 <= needed[0] <= 8 and needed[-1] < 52


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}


def test_pruning_loses_less_than_the_bands():
    config, t = JaccardConfig(), 0.8
    left, lost = {0: 1.0}, 0.0
    for needed in least_matches(config):
        after = {}
        for k, p in left.items():
            for j in range(config.step + 1):
                after[k + j] = after.get(k + j, 0.0) + p * comb(config.step, j) * t**j * (1 - t) ** (config.step - j)
        lost += sum(p for k, p in after.items() if k < needed)
        left = {k: p for k, p in after.items() if k >= needed}
    assert lost < 1e-7 and lost + (1 - t**config.rows) ** config.bands < 1e-6


def test_deduplicate_keeps_input_columns_of_any_name(spark):
    names = ["_id", "_th", "id", "th", "row", "h", "n", "d1", "d2", "bands", "node", "leader"]
    rows = [(k, t, *[f"{n}{i}" for n in names]) for i, (k, t) in enumerate(corpus())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = [tuple(r) for r in deduplicate(docs).collect()]
    assert deduplicate(docs).columns == docs.columns
    assert len(set(kept)) == len(kept) and set(kept) <= set(rows)
    assert {r[:2] for r in kept} == {tuple(r) for r in deduplicate(docs.select("doc_id", "text")).collect()}
    again = [tuple(r) for r in deduplicate(docs.repartition(7, "h")).collect()]
    assert set(again) == set(kept)  # which of the rows with one key and text stays does not depend on their order
