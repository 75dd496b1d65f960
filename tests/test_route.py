import random

import numpy as np
from pyspark.sql import functions as F

from docket.functions import route as FR
from docket.operators import route as R
from docket.operators import similar as S


def col(spark, f, vals):
    df = spark.createDataFrame([(v,) for v in vals], "q string")
    return [r[0] for r in df.select(f("q")).collect()]


def test_extract_module(spark):
    assert col(spark, FR.extract_module, ["Explain Module-3", "modules", "module 0", "MODULE_ 12"]) == [3, None, 0, 12]


def test_extract_semester(spark):
    assert col(spark, FR.extract_semester, ["3rd sem", "5sem", "2 seminars", "10 assembly"]) == [3, 5, 2, None]


def test_extract_subject(spark):
    assert col(spark, FR.extract_subject, ["those costs", "STACK overflow", "hello"]) == ["os", "dsa", None]


def test_classify(spark):
    got = col(spark, FR.classify, ["hello there", "send notes pdf", "explain paging", "the weather", "what?"])
    assert got == ["SMALL_TALK", "DIRECT_NOTES_REQUEST", "NOTES_QUERY", "OTHER", "NOTES_QUERY"]


def test_missing_question(spark):
    q = R.classify_questions(spark.createDataFrame([(1, ""), (2, None), (3, "hello")], "qid bigint, question string"))
    got = {r.qid: (r.category, r.answer) for r in R.dispatch(q, None, None).collect()}
    assert got == {1: ("MISSING", FR.REPLY_MISSING), 2: ("MISSING", FR.REPLY_MISSING), 3: ("SMALL_TALK", None)}


def _index(spark, paths):
    return spark.createDataFrame([(i, p, "u%d" % i) for i, p in enumerate(paths)], "pos bigint, path string, link string")


def test_candidate_files_module(spark):
    idx = _index(spark, ["os module 1", "os module 12", "dsa 11.pdf", "x 2.pdf"])
    q = spark.createDataFrame([(1, "module 1 notes"), (2, "module 7 please"), (3, "hi")], "qid bigint, question string")
    rows = R.candidate_files(q, idx).collect()
    by = {}
    for r in rows:
        by.setdefault(r.qid, []).append((r.path, r.all_files))
    assert sorted(by[1]) == [("dsa 11.pdf", False), ("os module 1", False), ("os module 12", False)]
    assert by[2] == [(None, True)] and by[3] == [(None, True)]


def _brute_candidates(q, paths):
    import re
    m = re.search(r"module\s*[-_ ]*(\d+)", q, re.I)
    s = re.search(r"(\d+)\s*(st|nd|rd|th)?\s*sem", q, re.I)
    mod = int(m.group(1)) if m else None
    sem = int(s.group(1)) if s else None
    lq = q.lower()
    subj = next((x.name for x in FR.SUBJECTS if any(k in lq for k in x.keywords)), None)
    out = []
    for i, p in enumerate(paths):
        f = p.lower()
        if mod and not any(t in f for t in (f"module {mod}", f"module_{mod}", f"mod {mod}", f"{mod}.")):
            continue
        if sem and not any(t in f for t in (f"{sem}rd sem", f"{sem}th sem", f"{sem}nd sem", f"{sem}st sem")):
            continue
        if subj and subj not in f:
            continue
        out.append(i)
    return out or list(range(len(paths)))


def _random_case(seed):
    rnd = random.Random(seed)
    words = ["os", "dsa", "maths", "ddco", "module", "mod", "sem", "1st", "3rd", "12th", "notes", "x1.", "2.",
             "module_3", "module 1", "module 12", "4th sem", "queue", "paging", " ", "a", "pdf"]
    paths = ["".join(rnd.choice(words) + rnd.choice([" ", "", "/"]) for _ in range(rnd.randint(1, 6)))
             for _ in range(25)]
    qs = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))) for _ in range(15)]
    return paths, qs


def test_candidates_and_fuzzy_match_brute_force(spark):
    for seed in range(3):
        paths, qs = _random_case(seed)
        idx = _index(spark, paths)
        qdf = spark.createDataFrame(list(enumerate(qs)), "qid bigint, question string")
        summ = {r.qid: r for r in R.candidate_summary(qdf, idx).collect()}
        best = {r.qid: r for r in S.fuzzy_best_file(qdf, idx, question_rows=4, tile_rows=3).collect()}
        for i, q in enumerate(qs):
            cands = _brute_candidates(q, paths)
            assert summ[i].n_candidates == len(cands), (q, paths)
            assert summ[i].first_pos == cands[0]
            scores = [S.dice(q.lower(), paths[j].lower()) for j in cands]
            top = max(scores)
            j = cands[scores.index(top)]
            assert best[i].path == paths[j], (q, best[i], paths[j])
            assert abs(best[i].rating - round(top, 6)) < 1e-9


def test_dice_goldens(spark):
    assert S.dice("night", "nacht") == 0.25
    assert S.dice("a b", "ab") == 1.0
    assert S.dice("a", "b") == 0.0
    df = spark.createDataFrame([("night", "nacht"), ("a b", "ab")], "a string, b string")
    assert [r[0] for r in df.select(S.bigram_dice("a", "b")).collect()] == [0.25, 1.0]


def test_fuzzy_empty_index(spark):
    idx = spark.createDataFrame([], "pos bigint, path string, link string")
    q = spark.createDataFrame([(1, "module 1")], "qid bigint, question string")
    assert S.fuzzy_best_file(q, idx).count() == 0


def test_dispatch_categories(spark):
    q = spark.createDataFrame([(1, "hi", "SMALL_TALK"), (2, "x", "WEIRD"), (3, "notes", "DIRECT_NOTES_REQUEST")],
                              "qid bigint, question string, category string")
    fm = spark.createDataFrame([(3, "a.pdf", "u")], "qid bigint, path string, link string")
    rows = {r.qid: r for r in R.dispatch(q, fm, None).collect()}
    assert rows[1].answer is None and rows[2].category == "OTHER"
    assert rows[2].answer == FR.REPLY_OTHER
    assert (rows[3].answer, rows[3].source_label, rows[3].source_link) == (FR.REPLY_FOUND, "a.pdf", "u")


def test_link_by_contains(spark):
    from docket.operators import context as X
    idx = spark.createDataFrame([(3, "A/Os Notes.PDF", "u3"), (1, "b/os notes.pdf", "u1"), (2, "xyz", "u2"),
                                 (4, "ab", "u4")], "pos bigint, path string, link string")
    names = spark.createDataFrame([("OS NOTES.pdf",), ("y",), ("none",), ("",), (None,), ("b",)], "name string")
    want = {"OS NOTES.pdf": "u1", "y": "u2", "none": None, "": "u1", None: None, "b": "u1"}
    got = {r.name: r.link for r in X.link_by_contains(names, idx).collect()}
    assert got == want
    got3 = {r.name: r.link for r in X.link_by_contains(names, idx, gram=2).collect()}
    assert got3 == want


def test_fuzzy_blocks_and_tiles_change_nothing(spark):
    paths, qs = _random_case(7)
    idx = _index(spark, paths)
    qdf = spark.createDataFrame(list(enumerate(qs)), "qid bigint, question string")
    want = sorted(tuple(r) for r in S.fuzzy_best_file(qdf, idx).collect())
    got = sorted(tuple(r) for r in S.fuzzy_best_file(qdf, idx, question_rows=1, tile_rows=1).collect())
    assert got == want


def test_fuzzy_nulls_and_ties(spark):
    idx = spark.createDataFrame([(2, "abc", "u2"), (1, "abc", "u1"), (3, None, "u3")], "pos bigint, path string, link string")
    q = spark.createDataFrame([(1, "a b c"), (2, None), (3, "zz"), (4, "a b c")], "qid bigint, question string")
    got = {r.qid: (r.link, r.rating) for r in S.fuzzy_best_file(q, idx).collect()}
    assert got == {1: ("u1", 1.0), 2: ("u3", 1.0), 3: ("u1", 0.0), 4: ("u1", 1.0)}


def test_dice_column_equals_dice(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 12)))
    pairs = [(word(), word()) for _ in range(200)]
    df = spark.createDataFrame([*pairs, (None, "ab")], "a string, b string")
    got = [r[0] for r in df.select(S.bigram_dice("a", "b")).collect()]
    assert got == [S.dice(a, b) for a, b in pairs] + [None]


def test_extract_subject_word_boundary(spark):
    df = spark.createDataFrame([("those costs",), ("my OS notes",), ("a stack.",)], "q string")
    got = [r[0] for r in df.select(FR.extract_subject("q", word_boundary=True)).collect()]
    assert got == [None, "os", "dsa"]


def test_bigram_matrix_and_best_name_equal_their_definitions():
    rng = random.Random(4)
    names = sorted({"", "a", "aa", "aaaa", "ab\0c", "\0\0\0", "é" * 5, "𝒳𝒴𝒳𝒴", *("".join(rng.choices("abcé𝒳 ", k=rng.randrange(2, 25))) for _ in range(200))})
    M, known = S._matrix(names)
    for i, s in enumerate(names):
        assert {t for t, c in known.items() if M[i, c]} == set(S._tokens(s))
    assert S._matrix(["", "x"])[0].shape == (2, 0)
    order = S._ordered(names)
    assert sorted(order) == list(range(len(names)))
    tile = S.Tile([names[i] for i in order], [(i % 5, True, names[i]) for i in order])
    qs = names[3:6] + ["".join(rng.choices("abcé𝒳x", k=rng.randrange(2, 40))).replace(" ", "") for _ in range(60)]
    block = S.Asked(qs)
    win, score, _ = tile.best(block, np.full(len(qs), -1.0))
    for q, w, d in zip(qs, win, score):
        best = max(2 * len(set(S._tokens(q)) & set(S._tokens(s))) / max(len(q) + len(s) - 2, 1) if q != s else 1.0 for s in names if len(s) > 1 or q == s)
        assert abs(d - best) < 1e-12 and w >= 0
    again, _, seen = tile.best(block, np.full(len(qs), 2.0))        # a score that no name reaches: nothing is compared
    assert (again == -1).all() and seen == 0
