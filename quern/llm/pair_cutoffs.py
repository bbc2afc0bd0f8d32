"""Chooses the cutoffs of the label model on labelled rows held out from it, and compares it with a majority vote.

`python -m quern.llm.pair_cutoffs` makes labelled rows by rule (programs, their damaged forms, and texts that stand in
their place), fits the model to the votes of one half without its labels, chooses each kind's cutoff there by F1, and
prints F1 and recall of model and majority on the other half. None of its texts stand in the tests."""

from __future__ import annotations

import json
import random
from collections import Counter

from quern.llm import pairs

PROBLEMS = [
    "A row of {n} lamps is lit one after the other, and every lamp that stands next to two dark ones goes out again. Count the lamps that are still lit after {m} rounds for each of the given rows.",
    "Given a tree with {n} nodes, find the longest path whose edges have weights that differ by at most {m}, and print the sum of its weights or -1 if there is none.",
    "Each of {n} teams plays each other team once. Decide how many of the games must be won by a team so that it is among the first {m} whatever the other results are.",
]
BODIES = [
    "import sys\n\ndef main():\n    n, m = map(int, sys.stdin.readline().split())\n    best = [0] * (n + 1)\n    for i in range(1, n + 1):\n        best[i] = max(best[i - 1], i % {m})\n    print(best[n])\n\nmain()",
    "from collections import defaultdict\n\nclass Graph:\n    def __init__(self, n):\n        self.adj = defaultdict(list)\n        self.n = n\n\n    def longest(self):\n        seen = {{0: 0}}\n        while len(seen) < self.n:\n            seen[len(seen)] = {m}\n        return seen\n\nprint(Graph(int(input())).longest())",
    "n = int(input())\ntable = {{\n    1: 'a;b',\n    2: 'c',\n}}\nif (k := n % {m}) in table:\n    print(table[k]);\nelse:\n    print(-1)",
    "def f(x):\n    # we can't help but try all of them here; unable to prune\n    return sum(1 for y in range(x) if y * y % {m} == 1)\n\nprint(f(int(input())))",
    "print(sum(int(x) % {m} for x in input().split()))",
]
REFUSALS = ["I'm sorry, but I can't assist with this one.", "Unfortunately I am unable to answer that.", "As an AI I must decline.", "Je regrette, je ne peux pas vous aider ici.", "Leider kann ich dabei nicht helfen.", "Lo siento, no puedo responder a esto.", "I won't be writing this program.", "This is not something I can write for you, sorry.", "Sorry, this one isn't for me.", "Apologies, the request goes too far.", "Sorry, but no."]
HUMAN = [
    "Man zählt zuerst die Lampen, die nicht am Rand stehen, und zieht dann von der Summe die Zahl der dunklen Lampen ab, so dass jede nur einmal gezählt wird.",
    "On trie les équipes par le nombre de points, puis on garde celles qui sont devant les autres, et la réponse est le rang de la dernière.",
    "Primero se ordenan los equipos por sus puntos y después se quitan los que no pueden estar entre los primeros, que son los que se cuentan.",
]
FOREIGN = [
    "#include <iostream>\nint main() {{\n  int n, s = 0;\n  std::cin >> n;\n  for (int i = 0; i < n; i++) s += i % {m};\n  std::cout << s;\n}}",
    "fn main() {{\n    let n: u64 = {m};\n    println!(\"{{}}\", n * 2);\n}}",
    "const n = {m};\nlet s = 0;\nfor (let i = 0; i < n; i++) {{ s += i; }}\nconsole.log(s);",
    "public class A {{\n  public static void main(String[] a) {{\n    System.out.println({m});\n  }}\n}}",
    "func main() {{\n\tx := {m}\n\tfmt.Println(x)\n}}",
]
NOTHING = ["", "   ", "# code follows below", "pass", "```python\n```", "<code></code>", "# TODO: implement\npass", "None", "...", "# see the attachment", "# answer"]


def rows(seed: int, n: int) -> list[tuple[str | None, str | None, str | None, str | None, str | None]]:
    """(problem, code, tests, defect of the code, defect of the tests)."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        fill = lambda t: t.format(n=r.randrange(5, 500), m=r.randrange(2, 90))
        problem, good = fill(r.choice(PROBLEMS)), fill(r.choice(BODIES))
        shown = lambda c: r.choice([c, c, f"```python\n{c}\n```", f"The idea is simple.\n\n```python\n{c}\n```\nIt is fast."])  # noqa: E731, B023
        kind = r.choice([None] * 9 + ["empty", "refusal", "copied", "wrong_language", "wrong_language", "truncated", "truncated"])
        if kind == "empty":
            code = r.choice(NOTHING)
        elif kind == "refusal":
            t = r.choice(REFUSALS)
            code = r.choice([t, "# " + t, f'print("{t}")', f"```\n{t}\n```"])
        elif kind == "copied":
            cut = r.randrange(60, len(problem) + 1)
            t = problem[: problem.rfind(" ", 0, cut)] if cut < len(problem) else problem
            code = r.choice([t, t.upper(), "# " + t, f'"""{t}"""', "Task: " + t])
        elif kind == "wrong_language":
            code = r.choice([r.choice(HUMAN), shown(fill(r.choice(FOREIGN)))])
        elif kind == "truncated":
            ends = [k for k in range(20, len(good) - 1) if not pairs.parse(good[:k])[0]]
            code = good[: r.choice(ends)] if ends else good[:-1]
            code = code if r.random() < 0.5 else "```python\n" + code
        else:
            code = shown(good)
        ins = [f"{r.randrange(99)} {r.randrange(99)}" for _ in range(r.randrange(2, 5))]
        outs = [str(r.randrange(100, 999)) for _ in ins]
        bad = r.choice([None] * 6 + ["empty", "truncated", "copied"])
        if bad == "empty":
            ins, outs = r.choice([([], []), (ins, [" "] * len(ins))])
        elif bad == "copied":
            outs = [f" {x}\n" for x in ins]
        tests = json.dumps({"inputs": ins, "outputs": outs[:-1] if bad == "truncated" and len(outs) > 1 and r.random() < 0.5 else outs})
        if bad == "truncated" and json.loads(tests)["outputs"] == outs:
            tests = tests[: r.randrange(12, len(tests) - 1)]
        out.append((problem, code, tests, kind, bad))
    return out


def patterns(of: list) -> list[list[int]]:
    return [[pairs._pattern(v) for v in pairs.code_votes(p, c) + pairs.tests_votes(t)] for p, c, t, _, _ in of]


def truth(row: tuple, i: int) -> bool | None:
    """Whether kind i is the defect of its field; None where another one of the same field holds, which comes first or after."""
    field, defect, _ = pairs.KINDS[i]
    real = row[3] if field == "code" else row[4]
    return True if real == defect else False if real is None else None


def f1(got: list[bool], want: list[bool]) -> tuple[float, float]:
    hits = sum(a and b for a, b in zip(got, want))
    recall = hits / max(1, sum(want))
    precision = hits / max(1, sum(got))
    return 2 * precision * recall / max(1e-9, precision + recall), recall


def first_defects(votes: list[list[int]], says) -> list[tuple[str | None, str | None]]:
    """The first defect of each field, says(kind, pattern) telling whether it holds."""
    out = []
    for v in votes:
        got = {}
        for i, (field, defect, _) in enumerate(pairs.KINDS):
            if field not in got and says(i, v[i]):
                got[field] = defect
        out.append((got.get("code"), got.get("tests_json")))
    return out


def validate(seed: int = 1, n: int = 6_000) -> dict:
    """Cutoffs by kind, and F1 of the first defects by model and by majority on rows the cutoffs weren't chosen on."""
    fit_rows, held = rows(seed, n), rows(seed + 1, n)
    votes, held_votes = patterns(fit_rows), patterns(held)
    counts = [Counter(v[i] for v in votes + held_votes) for i in range(len(pairs.KINDS))]
    post = [pairs.fit(counts[i], k, anchored=field == "code") for i, (field, _, k) in enumerate(pairs.KINDS)]
    cutoffs = []
    for i in range(len(pairs.KINDS)):
        known = [(post[i][v[i]], t) for v, row in zip(votes, fit_rows) if (t := truth(row, i)) is not None]
        grid = [x / 100 for x in range(50, 100)]
        score = [f1([p > x for p, _ in known], [t for _, t in known])[0] for x in grid]
        best = [x for x, s in zip(grid, score) if s >= max(score) - 1e-12]
        cutoffs.append(round((best[0] + best[-1]) / 2 if best[0] > 0.5 else 0.5, 2))
    ks = [k for _, _, k in pairs.KINDS]

    def majority(i: int, p: int) -> bool:
        said = [x for x in pairs._unpattern(p, ks[i]) if x != pairs.NONE]
        return 2 * sum(x == pairs.YES for x in said) > len(said)

    want = [(row[3], row[4]) for row in held]
    result = {"cutoffs": cutoffs, "between": sum(c for i in range(len(ks)) for p, c in counts[i].items() if 0.1 < post[i][p] < 0.9)}
    for name, says in (("model", lambda i, p: post[i][p] > cutoffs[i]), ("majority", majority)):
        got = first_defects(held_votes, says)
        flat = [(g == w and w is not None, g is not None, w is not None) for x, y in zip(got, want) for g, w in zip(x, y)]
        hits, said, real = (sum(c) for c in zip(*flat))
        result[name] = {"precision": hits / said, "recall": hits / real, "f1": 2 * hits / (said + real)}
    return result


if __name__ == "__main__":
    print(json.dumps(validate(), indent=1))
