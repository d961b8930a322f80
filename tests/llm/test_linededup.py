import random
import re

from sextant.llm import linededup as D


def brute(rows, words=8):
    """rows: (doc_id, text). Numbers of the lines to delete per row, by the rule as the module states it."""
    def order(i):
        return (rows[i][0] is None, rows[i][0] or 0, rows[i][1])

    lines = []
    for _, text in rows:
        split = [] if text is None else text.split("\n")
        lines.append([(i, x.strip(D.SPACE), len(re.split(r"[\x20\x09-\x0D]+", x.strip(D.SPACE)))) for i, x in enumerate(split) if x.strip(D.SPACE)])

    def run(ls, j):
        n, k = 0, j
        while k < len(ls) and n < words:
            n, k = n + ls[k][2], k + 1
        return k if n >= words else None

    return order, lines, run


def check(spark, rows, words=8):
    """Every long line that stands earlier goes, nothing that stands nowhere earlier goes, long runs go whole."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int, removed int, extra string")
    got = {r.place: r for r in D._joined(docs, words).collect()}
    out = {i: sorted(got[i][D.LINES] or []) for i in range(len(rows))}
    order, lines, run = brute([r[:2] for r in rows], words)
    by_order = sorted(range(len(rows)), key=order)
    seen_lines, seen_runs, seen_text = set(), set(), set()
    for i in by_order:
        if rows[i][:2] in seen_text:
            continue  # equal rows are one document
        seen_text.add(rows[i][:2])
        ls, gone = lines[i], set(out[i])
        here = []
        for j, (number, text, n) in enumerate(ls):
            if n >= words:
                assert (number in gone) == ((text,) in seen_runs), (i, number, text)
                seen_runs.add((text,))
            if number in gone:
                assert text in seen_lines or text in here, (i, number, text)
            here.append(text)
            # A repeated run of 2 * words - 1 words: all of it goes.
            total, k = 0, j
            while k >= 0 and total < 2 * words - 1:
                total, k = total + ls[k][2], k - 1
            whole = tuple(x[1] for x in ls[k + 1 : j + 1])
            if total >= 2 * words - 1:
                if whole in seen_runs and len(whole) > 1:
                    inside = [x[0] for x in ls[k + 1 : j + 1]]
                    assert gone & set(inside), (i, whole)
                seen_runs.add(whole)
        seen_lines.update(here)
    return out


def test_hand_made(spark):
    a = "one two three four five six seven eight"
    rows = [
        (1, f"{a}\nyes\nno", 0),
        (2, f"new line here\n{a}\nyes\nother", 1),
        (3, f"{a}\n\n{a}", 2),
        (4, None, 3),
        (5, "", 4),
        (None, a, 5),
        (7, "a b c\nd e f\ng h i\nj k l\nm n o\np q", 6),
        (8, "x\na b c\nd e f\ng h i\nj k l\nm n o\np q\ny", 7),
        (9, "short line", 8),
        (10, "short line", 9),
        (11, f"  {a}\t\nend", 10),
        (11, f"  {a}\t\nend", 11),
    ]
    out = check(spark, [(*r, 0, "x") for r in rows])
    assert out == {0: [], 1: [1, 2], 2: [0, 2], 3: [], 4: [], 5: [0], 6: [], 7: [1, 2, 3, 4, 5, 6], 8: [], 9: [], 10: [0], 11: [0]}


def test_random(spark):
    rng = random.Random(5)
    pool = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 12]))) for _ in range(120)]
    rows = []
    ids = rng.sample(range(1000), 80)
    for i in range(80):
        text = "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        if rng.random() < 0.5 and rows:
            other = rng.choice(rows)[1].split("\n")
            at = rng.randrange(len(other))
            text += "\n" + "\n".join(other[at : at + rng.randint(1, 8)])
        rows.append((ids[i], text, i, 0, "x"))
    check(spark, rows)


def test_drop(spark):
    a = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, a, 39), (2, a, 39), (3, f"{a}\nmore", 44), (4, "", 0), (5, None, None)], "doc_id long, text string, n_chars long")
    got = D.drop_repeated_lines(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, a, 39), (3, "more", 4), (4, "", 0), (5, None, None)]
    assert D.deduplicate(docs.where("false")).count() == 0


def test_query_against_brute_force(spark):
    import __spark_entry__ as e

    got = e.queries()["op3_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(docs)
    seen = set()
    for r in sorted(got, key=lambda r: r.doc_id):
        lines = docs[r.doc_id].split("\n")
        gone = set(r.removed)
        assert r.n_lines == len(lines) and r.n_removed == len(gone)
        assert r.text == "\n".join(x for i, x in enumerate(lines) if i not in gone)
        for i, x in enumerate(lines):
            if len(x.split()) >= 8:
                assert (i in gone) == (x.strip(D.SPACE) in seen)
                seen.add(x.strip(D.SPACE))
