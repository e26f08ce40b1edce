"""Every labelled credential teaches the automata."""

import random

from docmatch.llm import secret_scan
from tests.llm.cases import docs


def rows(n):
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    values = ["tk_" + "".join(rng.choice(letters) for _ in range(rng.choice([12, 22]))) for _ in range(n)]
    values += ["sk-live." + "".join(rng.choice("abcdef0123456789") for _ in range(9000)) for _ in range(3)]
    return [(i, f"see token = {v} there") for i, v in enumerate(values)], values


def test_values_beyond_any_number_or_length_teach(spark):
    table, values = rows(900)
    made = secret_scan.formats_of(docs(spark, table + table[:50]).repartition(5))
    plain = secret_scan.infer(sorted(values))
    assert sum(made.automata[0].ends) == len(set(values)) == 903, "a value counts once, whatever their number"
    assert sum(n for m in made.automata[0].moves for n, _ in m.values()) == sum(map(len, values)), "each of them whole"
    assert (made.automata[0].least, made.least) == (plain.least, 15)
    assert sorted(made.automata[0].ends) == sorted(plain.ends)
    assert all(abs(made.automata[0].score(v) - plain.score(v)) < 1e-12 for v in values)


def test_values_whose_prefixes_are_no_states_count_too(spark, monkeypatch):
    table, values = rows(300)
    monkeypatch.setattr(secret_scan, "TREE_STATES", 40)
    made = secret_scan.formats_of(docs(spark, table)).automata[0]
    assert sum(made.ends) == 303 and sum(n for m in made.moves for n, _ in m.values()) == sum(map(len, values))
    assert made.least == min(map(made.score, values)) and len(made.moves) <= 400
    other = ["abcdefghijklmno", "------------", "Tk+ABCDEFGH"]
    assert min(map(made.score, values)) > max(map(made.score, other))
    monkeypatch.setattr(secret_scan, "TREE_STATES", 0)
    none = secret_scan.formats_of(docs(spark, table)).automata[0]
    assert len(none.moves) == 1 and none.ends == [303], "without states of their own all values count at the start"
