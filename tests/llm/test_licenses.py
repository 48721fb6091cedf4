import itertools
import random

from seaweft.llm import licenses as lic


def test_increasing_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        js = rng.sample(range(9), rng.randint(0, 7))
        got = lic.increasing(list(enumerate(js)))
        best = max((len(c) for n in range(len(js) + 1) for c in itertools.combinations(js, n) if list(c) == sorted(c)), default=0)
        assert len(got) == best and [j for _, j in got] == sorted(j for _, j in got)


def test_alignment_matches_equal_words_in_order():
    rng = random.Random(2)
    for _ in range(200):
        a, b = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))], [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]
        pairs = lic.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    words = lic.words_of(lic.TEMPLATES["MIT"])
    assert len(lic.align(words, words)) == len(words)


def test_planted_notices_are_found():
    rng = random.Random(3)
    scanner = lic.Scanner(lic.TEMPLATES)
    noise = lambda n: " ".join(rng.choice(["the", "under", "of", "zebra", "lion", "and", "version", "license"]) for _ in range(n))
    for name, text in lic.TEMPLATES.items():
        for before in (0, 7, 3000):
            words = text.split()
            if len(words) > 30:  # a copy with some words changed
                for _ in range(len(words) // 12):
                    words[rng.randrange(len(words))] = "changed"
            hits = scanner.scan(noise(before) + "\n" + " ".join(words).upper() + "\n" + noise(40))
            assert any(h[0] == name and h[1] >= 0.8 and abs(h[2] - before) <= 12 for h in hits), (name, before, hits)
    assert scanner.scan("nothing of the kind is here, under a tree " * 50) == []


def test_query_finds_every_planted_line(spark):
    from seaweft.llm.queries import op5_license_scan
    root = "/root/testdata/sf0.01"
    lines = {k: v for k, v in lic.TEMPLATES.items() if k.endswith("-line")}
    want = {(r.doc_id, k) for r in spark.read.parquet(f"{root}/documents.parquet").collect() for k, v in lines.items() if v in r.text}
    got = {(r.doc_id, r.license) for r in op5_license_scan(spark, root).collect()}
    assert want and want == got


def test_edge_rows(spark):
    t = lic.TEMPLATES["MIT-line"]
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, t, 1), (3, t, 1), (3, t, 1), (4, "x " * 200_000 + t, 1)], "doc_id bigint, text string, license int")
    assert sorted((r.doc_id is None, r.doc_id, r.first_word) for r in lic.scan(df).collect()) == [(False, 3, 0), (False, 3, 0), (False, 4, 200_000), (True, None, 0)]
    assert lic.scan(df.limit(0)).collect() == [] and lic.scan(df, {"none": " .. "}).collect() == []


def verbatim(words, template):
    """Places of exact copies, from left to right, by plain comparison."""
    out, at = [], 0
    while at + len(template) <= len(words):
        hit = words[at : at + len(template)] == template
        out += [at] * hit
        at += len(template) if hit else 1
    return out


def test_planted_pairs_and_triples_against_plain_comparison():
    rng = random.Random(6)
    names = [n for n in lic.TEMPLATES if not n.startswith("BSD")]  # the two BSD texts cover each other
    scanner = lic.Scanner({n: lic.TEMPLATES[n] for n in names})
    for _ in range(40):
        parts = []
        for name in rng.choices(names, k=rng.choice([2, 3])):
            parts += [" ".join(f"pad{rng.randrange(50)}" for _ in range(rng.choice([0, 0, 1, 9, 200]))), lic.TEMPLATES[name]]
        text = " ".join(parts)
        words = lic.words_of(text)
        got = {(h[0], h[2]) for h in scanner.scan(text) if h[1] == 1.0}
        want = {(n, at) for n in names for at in verbatim(words, lic.words_of(lic.TEMPLATES[n]))}
        assert got == want


def test_adjacent_copies_are_found_each():
    scanner = lic.Scanner(lic.TEMPLATES)
    for name, text in lic.TEMPLATES.items():
        n = len(lic.words_of(text))
        for copies, gap in itertools.product(range(1, 7) if n < 40 else (1, 2, 3), (0, 2)):
            got = [h for h in scanner.scan(" ".join(["other"] * 40 + ([text] + ["between"] * gap) * copies + ["after"] * 30)) if h[0] == name]
            assert got == [(name, 1.0, at, at + n, n) for at in range(40, 40 + copies * (n + gap), n + gap)], (name, copies, gap, got)
