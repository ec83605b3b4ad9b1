"""Operators 3, 6, 7 and 10 against brute force, held-out accuracy and known cases."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from factorframe.llm import language_id, licenses, quality, secrets
from factorframe.llm.common import pieces
from factorframe.llm.symbols import BITS, table


def brute_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    where = defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i:i + 8])].append(i)
    repeated = {j for v in where.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        dups += line in seen and bool(line.strip(" \t\n\x0b\x0c\r"))
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(repeated)


def brute_kn(texts):
    """Modified Kneser-Ney of order 4 over symbols, with dictionaries: (history, symbol) -> probability."""
    t = table(False)
    grams = Counter()
    for x in texts:
        s = [0, 0, 0, *(int(t[ord(c)]) for c in x)]
        grams.update(tuple(s[i:i + 4]) for i in range(len(s) - 3))
    levels = {4: grams}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def discounts(c):
        n = Counter(c.values())
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 0.75, 1.0]
        y = n[1] / (n[1] + 2 * n[2])
        raw = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
        return [0] + [min(max(r, 0.05), top) for r, top in zip(raw[1:], (1, 2, 3))]

    d = {n: discounts(c) for n, c in levels.items()}
    follow = {n: defaultdict(list) for n in levels}
    for n, c in levels.items():
        for g, k in c.items():
            follow[n][g[:-1]].append(k)

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / 64
        own = follow[n].get(g[:-1])
        if not own:
            return lower
        total, k = sum(own), levels[n].get(g, 0)
        return (k - d[n][min(k, 3)]) / total + sum(d[n][min(x, 3)] for x in own) / total * lower

    return grams, p


def test_base_counts(small, odd, none):
    rows = [r.text for r in small.union(odd.select(*small.columns)).collect()] + ["a b c d e f g h " * 3, "x\nx\n \n \nx y\n", "é" * 50]
    got = []
    for _, data, offsets in pieces(pa.array(rows, pa.string()), 5000):
        got += list(zip(*(c.tolist() for c in quality.base_counts(data, offsets))))
    assert got == [brute_base(t) for t in rows]
    judged = {r.doc_id: r for r in quality.judge(odd).collect()}
    assert len(judged) == 11 and judged[1].n_words == 0 and judged[1].base_failed and not judged[1].kept and judged[7].n_words == 80_000
    assert quality.judge(none).count() == 0


def test_kneser_ney_equals_brute_force(spark, small):
    texts = [r.text for r in small.where("lang = 'de'").limit(12).collect()]
    docs = spark.createDataFrame([(i, t, "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    grams, p = brute_kn(texts)
    counted = {r.gram: r.n for r in quality.count(docs.select("text", "lang")).collect()}
    code = lambda g: sum(s << (BITS * i) for i, s in enumerate(reversed(g)))
    assert counted == {code(g): n for g, n in grams.items()}
    model = quality.kneser_ney(np.array(list(counted)), np.array(list(counted.values())))
    keys, counts, logp, low3, spare4, times3, low2, spare3 = model
    assert (np.diff(keys.astype(np.int64)) > 0).all()
    have = dict(zip(keys.tolist(), zip(counts.tolist(), logp.tolist())))
    for g in list(grams)[::37]:
        assert have[code(g)][0] == grams[g] and math.isclose(have[code(g)][1], math.log(p(g)), abs_tol=1e-4)
        unseen = (*g[:3], (g[3] + 13) % 64)
        if unseen not in grams:
            assert math.isclose(spare4[code(g[:3])] + low3[code(unseen[1:])], math.log(p(unseen)), abs_tol=1e-3)
        assert math.isclose(sum(p((*g[:3], s)) for s in range(64)), 1, abs_tol=1e-6)
    all3 = Counter()
    for g, n in grams.items():
        all3[g[1:]] += n
    for _, data, offsets in pieces(pa.array(texts)):
        for got, text in zip(quality.score(data, offsets, model), texts):
            s = [0, 0, 0, *(int(table(False)[ord(c)]) for c in text)]
            own = Counter(tuple(s[i:i + 4]) for i in range(len(text)))
            own3 = Counter(tuple(s[i + 1:i + 4]) for i in range(len(text)))
            total = 0.0
            for g, m in own.items():  # a gram of this text alone falls back to the order below
                if grams[g] > m:
                    total += m * math.log(p(g))
                elif all3[g[1:]] > own3[g[1:]]:
                    total += m * float(spare4[code(g[:3])] + low3[code(g[1:])])
                else:
                    total += m * float(spare4[code(g[:3])] + spare3[code(g[1:3])] + low2[code(g[2:])])
            assert math.isclose(got, -total / len(text), abs_tol=1e-3)


def test_perplexity_rejects_noise_and_keeps_prose(spark, small):
    rng = np.random.default_rng(0)
    noise = ["".join(chr(c) for c in rng.integers(33, 126, 2000)).replace("Q", " ").replace("z", " ").replace("W", " ") for _ in range(3)]
    docs = small.select("doc_id", "text", "lang").union(spark.createDataFrame([(9000 + i, t, "en") for i, t in enumerate(noise)], "doc_id long, text string, lang string"))
    got = quality.judge(docs).toPandas()
    assert not got[got.doc_id >= 9000].kept.any()
    plain = got[(got.doc_id < 9000) & ~got.base_failed]
    assert plain.kept.mean() > 0.97


def test_languages_held_out(small, odd, none):
    got = language_id.identify(small).toPandas().merge(small.select("doc_id", "lang").toPandas(), on="doc_id")
    assert 0.1 < got.held_out.mean() < 0.4
    held = got[got.held_out & (got.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() >= 0.95 and got.score.between(0, 1).all()
    rows = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert len(rows) == 11 and all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 9)) and not rows[None].held_out
    assert language_id.identify(none).count() == 0
    kept = language_id.in_a_language(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {4, 5, None, 7, 8, 10, 11} and kept.where("doc_id = 5").count() == 2


def test_mixture_inference():
    rng = np.random.default_rng(2)
    right, wrong = -10.0, -16.0
    scores = np.full((300, 3), wrong) + rng.normal(size=(300, 3))
    scores[:100, 0] = right
    scores[100:160, 1] = right
    scores[160:200, 2] = right
    scores[200:, 1] = right
    chosen, share = language_id.infer(scores.astype(np.float32), np.array([0, 200]), np.array([200, 100]))
    assert chosen.tolist() == [[1, 1, 1], [0, 1, 0]]
    assert np.allclose(share, [[0.5, 0.3, 0.2], [0, 1, 0]], atol=0.03)


def test_patience_alignment():
    rng = np.random.default_rng(4)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = rng.integers(0, 12, rng.integers(0, 25)).tolist(), rng.integers(0, 12, rng.integers(0, 25)).tolist()
        got = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        assert len(got) <= longest(a, b)
    unique = list(range(60))
    for _ in range(50):  # words unique in both: patience finds the longest common subsequence
        a = rng.permutation(unique).tolist()
        assert len(licenses.patience(a, unique)) == longest(a, unique)
    places = [3, 1, 2, 2, 5, 4]
    got = [places[i] for i in licenses.rising(places)]
    assert len(got) == 3 and got == sorted(set(got)) and licenses.rising([]) == []


def test_license_scan(spark, odd, none):
    mit = licenses.TEMPLATES["MIT-text"]
    filler = "the of to any person in and " * 300
    cut = mit.split()
    cut[10:14], cut[60] = ["deliberately", "altered"], "someone"
    rows = [(1, f"{filler}{mit}\n{filler}"), (2, filler + " ".join(cut)), (3, filler), (4, "released UNDER, the -- mit license!"), (5, mit[:200]), (6, f"{mit} {mit}"), (7, None)]
    got = {(r.doc_id, r.license): r.coverage for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "MIT-text"] == 1 and 0.9 < got[2, "MIT-text"] < 1 and got[4, "MIT"] == 1 and got[6, "MIT-text"] == 1
    assert {k[0] for k in got} == {1, 2, 4, 6}
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


def test_licenses_in_the_table(small):
    """The lines of the table are notices as they stand in the templates: nothing but these is found, each once."""
    got = sorted((r.doc_id, r.license) for r in licenses.scan(small).collect())
    lines = {t: n for n, t in licenses.TEMPLATES.items()}
    want = sorted((r.doc_id, lines[line.strip()]) for r in small.collect() for line in (r.text or "").split("\n") if line.strip() in lines)
    assert want and got == want


SENTENCES = {
    "Licensed under CC BY 4.0": ["CC-BY-4.0"], "Licensed under CC BY-SA 4.0": ["CC-BY-SA-4.0"], "Licensed under CC BY-ND 4.0": ["CC-BY-ND-4.0"],
    "Licensed under CC BY-NC-SA 3.0": ["CC-BY-NC-SA-3.0"], "Licensed under CC BY-XX 4.0": [], "Licensed under CC BY 5.0": [],
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0-header"],
    "This work is licensed under the GNU Lesser General Public License, version 3": ["LGPL-3.0"],
    "This work is licensed under the GNU Affero General Public License, version 3": ["AGPL-3.0"],
    "This work is licensed under the GNU General Public License, version 2": ["GPL-2.0"],
    "This work is licensed under the GNU Other General Public License, version 3": [],
    "This work is licensed under the GNU General Public License, version 4": [],
    "This work is licensed under the GNU General Public License, version 3 or any later version": ["GPL-3.0-or-later-notice"],
    "Licensed under the Mozilla Public License, Version 2.0": ["MPL-2.0"], "Licensed under the Apache License, Version 2.1": [],
    "Licensed under the Apache License, Version 1.1": ["Apache-1.1"], "Released under the BSD License": [], "Released under the ISC License": ["ISC"],
    "Released under the Open Database License": ["ODbL-1.0"], "Licensed under the MIT License": ["MIT"],
    "Their third album was released under the label's old license in 1998": [], "Released under the terms of a license that is like the MIT License": [],
    "Released under the MIT License. Licensed under CC BY-NC 4.0.": ["MIT", "CC-BY-NC-4.0"],
}


def test_neighbouring_licenses(spark):
    rows = [(i, f"some words before it. {t} and some after") for i, t in enumerate(SENTENCES)]
    got = [[] for _ in rows]
    for r in sorted(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.first_word):
        got[r.doc_id].append(r.license)
    assert dict(zip(SENTENCES, got)) == SENTENCES


def brute_license(text, templates, least=0.8):
    """Best (aligned, name) over all stretches of a text, aligned by longest common subsequence."""
    words, found = licenses.template_words(text), []
    for name, rule in licenses.rules(templates, least).items():
        n = len(rule.template)
        for a in range(len(words)):
            for b in range(a + 1, min(len(words), a + 2 * n) + 1):
                got = common(words[a:b], rule.template)
                if got and rule.holds(got):
                    found.append((len(got), name))
    return max(found)[1] if found else None


def common(a, b):
    """Places of a longest common subsequence."""
    best = [[()] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + ((i, j),) if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j], key=len)
    return list(best[-1][-1])


def test_licenses_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    templates = {n: licenses.TEMPLATES[n] for n in ("MIT", "ISC", "Apache-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0")}
    rows = []
    for i in range(120):
        words = licenses.re.findall(r"\w+", templates[sorted(templates)[i % len(templates)]])
        for _ in range(rng.integers(0, 3)):  # words go, come or change
            k = int(rng.integers(0, len(words)))
            words[k:k + int(rng.integers(0, 2))] = [str(rng.choice(["other", "lesser", "sa", "mit", "3"]))] * int(rng.integers(0, 2))
        rows.append((i, " ".join(["alpha", "beta"] + words + ["gamma"])))
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    want = {i: n for i, t in rows if (n := brute_license(t, templates))}
    assert got == want and 40 < len(got) < 120


def test_a_whole_text_beats_the_part_of_it(spark):
    """Three clauses hold the text of two; a header holds the short notice."""
    names = ["BSD-2-Clause-text", "BSD-3-Clause-text", "Apache-2.0-header", "GPL-2.0-or-later-header", "LGPL-2.1-or-later-header", "MPL-2.0-header"]
    rows = [(i, "// " + licenses.TEMPLATES[n].replace(". ", ".\n// ")) for i, n in enumerate(names)]
    got = {r.doc_id: (r.license, r.coverage) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (n, 1.0) for i, n in enumerate(names)}



def _hex(i):
    return "".join("0123456789abcdef"[(i * 7919 + j * j * 31 + j * i) % 16] for j in range(40))


def test_secrets(spark, odd, none):
    rows = [(i, f'some words here token = "{_hex(i)}" and the rest', "s") for i in range(60)]
    rows += [(100 + i, f"the card {4000000000000000 + 7 * i} was used and commit {_hex(900 + i)} was built", "s") for i in range(60)]
    rows += [(300, f"deploy with api_key: '{_hex(5000)}'", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secrets.scan(docs).toPandas()
    assert set(got[got.is_secret].doc_id) == {*range(60), 300} and len(got) == 60 + 120 + 1
    out = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert out[300] == "deploy with api_key: '<SECRET>'" and out[3] == 'some words here token = "<SECRET>" and the rest' and out[101] == rows[61][1]
    changed = secrets.redacted(odd)
    assert changed.columns == odd.columns
    text = {r.doc_id: r for r in changed.collect()}
    assert text[11].text == 'token = "<SECRET>" is in here' and text[11].n_chars == len(text[11].text) and text[1].text is None and changed.count() == 12
    assert secrets.scan(none).count() == 0 and secrets.redacted(none).count() == 0


def test_forest(spark):

    rng = np.random.default_rng(8)
    x = rng.random((400, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0.6).astype(int)
    found = spark.createDataFrame([(r.tolist(), int(v), i) for i, (r, v) in enumerate(zip(x, y))], "features array<double>, label long, value_hash long")
    forest = secrets.train(found, 1000, trees=7, depth=4)
    got = secrets.vote(forest, x, [None] * 400)
    assert ((got >= 0.5) == y).mean() > 0.9
    assert secrets.train(found.where("label = 1"), 1000) is None
    again = secrets.vote(secrets.train(found, 1000, trees=7, depth=4), x, [None] * 400)
    assert np.allclose(got, again)


def test_every_notice_of_a_text(spark):
    far = "nothing of note stands here " * 40
    talk, notice = "The MIT License covers code released under it.", "Released under the MIT License."
    mit = licenses.TEMPLATES["MIT-text"]
    rows = [(1, f"{talk} {far} {notice}"), (2, f"{notice} {far} {notice} {notice} {far} {talk}"), (3, f"{mit} {far} {mit} {mit}"), (4, f"{talk} {far} {talk}"), (5, f"{talk} {notice}")]
    got = sorted(tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(licenses.template_words(mit))
    assert got == [(1, "MIT", 1.0, 208, 212), (2, "MIT", 1.0, 0, 4), (2, "MIT", 1.0, 205, 209), (2, "MIT", 1.0, 210, 214),
                   (3, "MIT-text", 1.0, 0, n - 1), (3, "MIT-text", 1.0, n + 200, 2 * n + 199), (3, "MIT-text", 1.0, 2 * n + 200, 3 * n + 199), (5, "MIT", 1.0, 8, 12)]


def test_languages_are_counted_in_small_pieces(spark, monkeypatch):
    """What a task holds of numbers for each character is bounded by the piece, in learning as in judging."""
    whole = language_id.pieces

    def small(column, limit=2_000_000):
        for at, data, offsets in whole(column, limit):
            assert len(data) <= 500_000 or len(offsets) == 2
            yield at, data, offsets

    rows = [("the cat sat on the mat " * 40, "en")] * 900 + [("der hund lag auf dem boden " * 40, "de")] * 900
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    langs, model = language_id.learn(df)
    monkeypatch.setattr(language_id, "pieces", small)
    again, cut = language_id.learn(df)
    assert langs == again == ["de", "en"] and (model == cut).all()
