import json

import pytest
from pyspark.sql import functions as F

from quern.llm import pairs

PROBLEM = "Two players take turns removing stones from a heap of 17. Find the number of moves that the first player needs, and print it for each of the given cases in the input."
GOOD = "import sys\n\ndef solve(n):\n    # sorry for the brute force\n    best = 0\n    for k in range(n):\n        best = max(best, k % 7)\n    return best\n\nprint(solve(int(input())))"
FENCED = f"Here is my solution:\n\n```python\n{GOOD}\n```\nThis runs in linear time."
CODE = {
    "empty": [None, "", " \n\t", "```python\n```", "<answer></answer>", "# TODO", "# your code here", "pass", "...", "N/A", "None", "```python\n# solution goes here\npass\n```", "```\n\n```", "-"],
    "refusal": ["I'm sorry, but I can't help with that.", "As an assistant, I have to decline this request.", "# Sorry, this request is outside what I can do.", 'print("Unfortunately, I am not able to write this.")', "Lo siento, no puedo ayudar con esto.", "Tut mir leid, dabei kann ich nicht helfen.", "Je suis désolé, je ne peux pas répondre à cela.", "```python\n# I cannot provide code for this.\n```", "Request declined (x): no code will be given."],
    "copied": [PROBLEM, PROBLEM.lower(), "# " + PROBLEM, f'"""{PROBLEM}"""', "Problem: " + PROBLEM, PROBLEM[:90], PROBLEM.replace(". ", ".\n"), "\n".join("# " + x for x in PROBLEM.split(". "))],
    "wrong_language": [
        "#include <bits/stdc++.h>\nusing namespace std;\nint main() { int n; cin >> n; cout << n % 7 << endl; }",
        'package main\nimport "fmt"\nfunc main() {\n  n := 3\n  fmt.Println(n)\n}',
        'fn main() {\n    let mut x: u64 = 3;\n    x += 2;\n    println!("{}", x);\n}',
        "public class Main {\n    public static void main(String[] args) {\n        System.out.println(3);\n    }\n}",
        "const f = (a) => {\n  let s = 0;\n  for (const x of a) { s += x; }\n  return s;\n};\nconsole.log(f([1, 2]));",
        "Der Prüfer erwartet die Zahl, aber das Programm liefert eine andere. Warum endet die Schleife nicht bei der Lampe?",
        "La suite croît de trois à chaque étape. Trouver le plus petit nombre tel que la somme dépasse dix pour tous les joueurs.",
        "La sucesión crece con cada paso del jugador. Hallar el menor número para el cual la suma supera los diez puntos.",
    ],
    "truncated": [GOOD[:60], GOOD[: GOOD.index("max(best") + 9], GOOD[: GOOD.index("range(n)") + 9], GOOD + "\nx = 'abc", GOOD + "\nif x:\n", FENCED[: FENCED.index("% 7")], GOOD + "\nfoo(1, [2,"],
    None: [GOOD, FENCED, "print(int(input()) % 7)", "```\n" + GOOD + "\n```", GOOD.replace("sorry", "I can't believe we need"), f'"""{PROBLEM}"""\n' + GOOD],
}
T = lambda i, o, **k: json.dumps({"inputs": i, "outputs": o} | k)
TESTS = {
    "empty": ["{}", "[]", T([], []), '{ "inputs" : [ ] , "outputs" : [ ] }', T(["1", "2"], ["\n", " "]), T(["1"], [""], fn_name="f")],
    "truncated": [T(["1 2", "3 4"], ["5", "6"])[:-4], '{"inputs": ["1', T(["1", "2", "3"], ["4", "5"]), '{"inputs": ["1 2"], '],
    "copied": [T(["1 2", "3"], ["1 2\n", " 3"]), T(["7"], ["7"], fn_name="f")],
    None: [None, "", T(["1 2", "3"], ["1 2", "4"]), T(["1"], ["x"], fn_name="f"), T(["[1, 2]"], ["{}"])],
}


@pytest.fixture(scope="module")
def labelled(spark):
    rows, want = [], {}
    for _ in range(3):
        for defect, codes in CODE.items():
            for c in codes:
                want[len(rows), "code"] = defect
                rows.append((len(rows), PROBLEM, c, T(["1"], ["2"])))
        for defect, tests in TESTS.items():
            for t in tests:
                want[len(rows), "tests_json"] = defect
                rows.append((len(rows), PROBLEM, GOOD, t))
    for k in range(400):  # most rows are sound
        rows.append((len(rows), PROBLEM, GOOD.replace("7", str(k)), T([str(k)], ["yes"])))
    df = spark.createDataFrame(rows, "id long, p string, c string, t string").withColumn("kind", F.lit(1)).repartition(4)
    found = pairs.defects(df, "id", "p", "c", "t").collect()
    return rows, want, found


def test_the_cutoffs_separate_the_fixture(labelled):
    rows, want, found = labelled
    first = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        first.setdefault((r.id, r.field), r.defect)
    for key, defect in want.items():
        assert first.get(key) == defect, (rows[key[0]], first.get(key), defect)
    assert set(first) <= set(want)


def test_several_labels_are_kept(labelled):
    rows, _, found = labelled
    i = next(r[0] for r in rows if r[2] == "```python\n# I cannot provide code for this.\n```")
    assert "refusal" in {r.defect for r in found if r.id == i}
    assert all(0.5 < r.posterior <= 1 for r in found)


def test_without_a_problem(spark):
    rows = [(1, None, "Der Prüfer erwartet die Zahl, aber das Programm liefert eine andere. Warum endet die Schleife nicht?", None), (2, None, None, None)] + [(k, None, GOOD, None) for k in range(10, 60)]
    got = {(r.id, r.defect) for r in pairs.defects(spark.createDataFrame(rows, "id long, p string, c string, t string"), "id", "p", "c", "t").collect()}
    assert (2, "empty") in got and not {i for i, _ in got if i >= 10}


def test_em_finds_the_accuracies():
    import random

    r = random.Random(1)
    counts, truth = {}, {}
    for _ in range(20_000):
        bad = r.random() < 0.05
        votes = [2 if (r.random() < (0.9 if bad else 0.02)) else 1 for _ in range(3)] + [0]
        p = pairs._pattern(votes)
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(bad)
    post = pairs.fit(counts, 4)
    for p, v in truth.items():
        if len(v) > 100:
            assert abs(post[p] - sum(v) / len(v)) < 0.1
    assert pairs.fit({}, 4) == {}


def test_very_long_and_odd_texts(spark):
    rows = [(1, PROBLEM, "x = " + "(" * 300, None), (2, PROBLEM, "a = 1\n" * 50_000, "[" * 500), (3, "", "\x00", "\x00"), (4, PROBLEM, "word " * 40_000, "7")]
    pairs.defects(spark.createDataFrame(rows, "id long, p string, c string, t string"), "id", "p", "c", "t").collect()


def test_empty(spark):
    assert pairs.defects(spark.createDataFrame([], "id long, p string, c string, t string"), "id", "p", "c", "t").count() == 0


FRAMES = {
    "empty": ["raise NotImplementedError", "raise NotImplementedError('solve')", "def solve(): pass # TODO", "import sys\n\ndef solve(n):\n    # your code here\n    return None\n\nif __name__ == '__main__':\n    solve(1)", "class Solution:\n    def solve(self, n):\n        '''Number of moves that a player needs for a heap of n stones in the game of the task.'''\n        raise NotImplementedError()"],
    "refusal": ["import sys\nprint(\"Sorry, I can't help with that.\")", "message = \"I'm sorry, but I can't help with that.\"\nprint(message)", "def solve():\n    # I cannot provide code for this.\n    pass"],
    "copied": [f'problem = """{PROBLEM}"""', f"import sys\nproblem = {PROBLEM!r}\nprint(problem)"],
    None: ["import sys\nprint(int(sys.argv[1]) % 7)", "n = int(input())\n# TODO\nprint(n)", "def solve(n):\n    return n % 7\n\nprint(solve(int(input())))", "import sys"],
}


def test_frames_without_a_program(spark):
    rows, want = [], {}
    for defect, codes in [*CODE.items(), *FRAMES.items()]:
        for c in codes * 3:
            want[len(rows)] = defect
            rows.append((len(rows), PROBLEM, c, None))
    rows += [(len(rows) + k, PROBLEM, GOOD.replace("7", str(k)), None) for k in range(400)]
    first = {}
    for r in sorted(pairs.defects(spark.createDataFrame(rows, "id long, p string, c string, t string"), "id", "p", "c", "t").collect(), key=lambda r: r["rank"]):
        first.setdefault(r.id, r.defect)
    assert {i: (d, rows[i][2]) for i, d in first.items() if d != want.get(i)} == {}
    assert {rows[i][2] for i, d in want.items() if d and i not in first} == set()


def test_long_sums_of_strings_are_read():
    assert pairs.code_votes(PROBLEM, "x = " + " + ".join(["'a'"] * 3_000))


def test_cutoffs_on_held_out_rows():
    from quern.llm import pair_cutoffs

    got = pair_cutoffs.validate(5, 2_000)
    assert got["model"]["f1"] > 0.97 and got["model"]["precision"] > 0.98 and all(0.5 <= c < 1 for c in got["cutoffs"])
    assert [abs(a - b) < 0.3 for a, b in zip(got["cutoffs"], pairs.CUTOFFS)] == [True] * len(pairs.KINDS)


def test_an_anchor_keeps_sound_rows_out():
    # Many sound programs speak of what they can't do: without the anchor the model takes them for refusals.
    speaks, refuses, plain, cut = [2, 1, 1, 2, 1], [2, 2, 2, 2, 0], [1, 1, 1, 0, 1], [1, 1, 2, 0, 0]
    counts = {pairs._pattern(p): n for p, n in ((speaks, 700), (refuses, 300), (plain, 2_000), (cut, 1_800))}
    post = pairs.fit(counts, 5, anchored=True)
    assert post[pairs._pattern(refuses)] > 0.9 and post[pairs._pattern(speaks)] < 0.1
