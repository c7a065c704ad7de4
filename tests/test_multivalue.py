import math
import random
from collections import defaultdict

import pytest

from docketry.operators.multivalue import Model, as_written, chunks, learn, read_field, split_field, split_values

VALUES = ["{} U.S.C. {}", "Pub. L. {}-{}", "Pub. L. {}-{}, Sec. 4(b)", "({} Stat. {})", "Executive Order {}, Sec. {}", "H. Res. {}, {}th Cong.", "{} U.S.C. {} note"]


def made(n, seed=1):
    r = random.Random(seed)
    rows, truth = [], []
    for i in range(n):
        values = [r.choice(VALUES).format(r.randint(1, 99), r.randint(1, 400)) for _ in range(r.choice([1, 1, 2, 3, 5]))]
        if r.random() < 0.1:
            values[0] = "Foo and Bar Act of 1999; part B"
        shown = [f'"{v}"' if "Act" in v else v for v in values]
        text = shown[0]
        for s in shown[1:]:
            text += r.choice(["; ", "; ", "; and ", ";; ", "|", " • ", ", ", " and ", " / ", "\n"]) + s
        rows.append((i, text))
        truth += [(i, k + 1, v) for k, v in enumerate(values)]
    return rows, truth


def test_learns_to_split(spark, scratch):
    rows, truth = made(1500)
    out = split_values(spark.createDataFrame(rows, "id int, f string"), ["id"], "f", scratch)
    got = {tuple(r) for r in out.collect()}
    assert len(got ^ set(truth)) <= 0.01 * len(truth)


def test_quotes_brackets_and_wraps(spark, scratch):
    rows, _ = made(1500)
    model = learn(spark.createDataFrame(rows, "id int, f string"), "f", scratch)
    f = lambda t: split_field(t, model, {})
    assert f('"A, B; and C | D"') == ["A, B; and C | D"]
    assert f('"The ""Sunrise"" Act"; 4 U.S.C. 5') == ['The "Sunrise" Act', "4 U.S.C. 5"]
    assert f("Pub. L. 1-2,\n  Sec. 4(b); (97\nStat. 5)") == ["Pub. L. 1-2, Sec. 4(b)", "(97 Stat. 5)"]
    assert f("Pub. L. 1-2 (as added by Pub. L. 3-4; 5 Stat. 6)") == ["Pub. L. 1-2 (as added by Pub. L. 3-4; 5 Stat. 6)"]
    assert f("4 U.S.C. 5; 4 U.S.C. 5 ;;") == ["4 U.S.C. 5", "4 U.S.C. 5"]


def test_odd_fields(spark, scratch):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, 'a "b; c', "x"), (4, 'a "b; c', "x"), (5, "w" * 100_000, "x"), (6, ";;,", "x")], "id int, f string, value string")
    out = split_values(df, ["id"], "f", scratch)
    assert sorted((r["id"], r["item_no"], len(r["value"])) for r in out.collect()) == [(4, 1, 4), (4, 1, 4), (4, 2, 1), (4, 2, 1), (5, 1, 100_000)]
    assert split_values(df.limit(0), ["id"], "f", scratch).count() == 0


def test_round_trip_of_tokens():
    text = ' "Q; x" and 4 U.S.C. 5(a)(1), (9 Stat. 9)'
    field = read_field(text)
    assert [text[a:b] for a, b, _ in field.tokens] == ['"Q; x"', "4", "U.S.C.", "5(a)(1)", "(9 Stat. 9)"]
    assert len(field.gaps) == 4 and len(list(chunks(field))) == 1


def test_viterbi_is_the_best_path():
    model = Model({"a": 5, "b": 3, "a, b": 2, "c": 1}, {",": 0.3})
    r = random.Random(3)
    for _ in range(50):
        shapes = [r.choice("abcd") for _ in range(r.randint(1, 7))]
        gaps = [","] * (len(shapes) - 1)
        arcs = {(i, j): p for i, j, _, p in model.arcs(shapes, gaps)}

        def paths(at, n=len(shapes)):
            if at == n:
                yield [], 0.0
            for j in range(at + 1, n + 1):
                for rest, p in paths(j):
                    yield [j, *rest], p + arcs[at, j]

        best = max(p for _, p in paths(0))
        ends = model.best(shapes, gaps)
        assert sum(arcs[a, b] for a, b in zip([0, *ends], ends)) == pytest.approx(best)


def test_as_written():
    assert as_written('"a ""b"" c"') == 'a "b" c' and as_written("“x  y”") == "x y" and as_written(' "a" and "b ') == '"a" and "b'
    assert as_written('"a" and "b"') == '"a" and "b"'


def test_a_long_value_beside_others_stays_whole():
    long = ["L"] + ["w"] * 38 + ["E"]
    gaps = ["sp"] * 39
    whole = " ".join(long)
    model = Model({whole: 10, "c": 10, "L": 1, "w": 2, "E": 1}, {",": 0.5, "sp": 0.02})
    assert model.best([*long, "c"], [*gaps, ","]) == [40, 41]
    assert model.best(["c", *long, "c"], [",", *gaps, ","]) == [1, 41, 42]
    # an unlearnt one too, and it is counted
    model = Model({"c": 10}, {",": 0.5, "sp": 0.02})
    assert model.best(["c", *long, "c"], [",", *gaps, ","]) == [1, 41, 42]
    values, cuts = defaultdict(float), defaultdict(float)
    model.expect(["c", *long, "c"], [",", *gaps, ","], 1.0, values, cuts)
    apart = 1 / (1 + math.exp(-1))  # against one unlearnt value with a neighbour, one token longer
    assert values[whole] == pytest.approx(apart**2) and values["c"] == pytest.approx(2 * apart)
