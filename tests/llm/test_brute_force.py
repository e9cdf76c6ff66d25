"""Learned operators and the pipeline against plain re-countings of what they state."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from pathloom.llm import decontaminate, langid, neardup, toxicity, urlfilter  # noqa: E402

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def _crc(x, n):
    return zlib.crc32(str(x).encode()) % n


# --- toxicity -----------------------------------------------------------------------------------------------


def _fold(text):
    out = []
    for char in text or "":
        kind = unicodedata.category(char)
        if kind in ("Mn", "Me", "Cf"):
            continue
        base = unicodedata.normalize("NFKD", char)[0].lower()[:1]
        base = toxicity.LOOKALIKES.get(char.lower()[:1], toxicity.LOOKALIKES.get(base, base))
        out.append(base if unicodedata.category(base)[0] == "L" else " ")
    return f" {''.join(out)} "


def _density(entries, folded):
    spans = [(m.start(), m.end() - 1) for phrase in toxicity.EXCEPTIONS for m in re.finditer(f"(?= {phrase} )", folded) for m in [re.compile(f" {phrase} ").match(folded, m.start())]]
    total = 0.0
    for start in range(len(folded)):
        if folded[start] == " " and not any(a <= start < b for a, b in spans):
            total += max((w for e, w in entries.items() if folded.startswith(e, start)), default=0.0)
    return total / (1 + math.log2(1 + folded.count(" ") / 100))


def _toxic_rows():
    rng = random.Random(7)
    vocab = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in ("mer", "nal")]
    rows = []
    for k in range(400):
        words = rng.choices(vocab, k=rng.randint(5, 60))
        if k % 4 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["zarkon", "z4rkish", "Zаrkite", "blemple", "stupid"])
        if k % 7 == 0:
            words += ["trash", "can", "not", "stupid"]
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    return rows + [(1000, None, 0), (1001, "", None), (8, "second text of an id zarkon", None)]


def test_toxicity_by_brute_force(spark):
    rows = _toxic_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, c0 string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(t)
    sample = [(_fold(min((t for t in texts[i] if t is not None), default=None)), y) for i, _, y in rows if y is not None and _crc(i, 5)]
    kinds = Counter(y for _, y in sample)
    seen = Counter()
    for folded, y in sample:
        words = set(folded.split())
        seen.update({(f" {w} ", y) for w in words if 3 <= len(w) <= 40} | {(f" {w[:n]}", y) for w in words for n in range(4, 9) if len(w) >= n})
    found = {}
    for e in {e for e, _ in seen}:
        a, b = seen[e, 1], seen[e, 0]
        if a:
            odds = math.log((a + 0.5) / (kinds[1] + 1)) - math.log((b + 0.5) / (kinds[0] + 1))
            rate = (a + b) / sum(kinds.values())
            evidence = 2 * (a * math.log(a / (rate * kinds[1])) + (b * math.log(b / (rate * kinds[0])) if b else 0))
            if odds >= toxicity.PURITY and evidence >= toxicity.EVIDENCE:
                found[e] = odds
    want = {f" {w} ": toxicity.SEED_WEIGHT for w in toxicity.SEED}
    for e in sorted(found, key=lambda e: (len(e), e)):
        if not any(e[:n] in want for n in range(2, len(e))):
            want[e] = found[e]
    assert model.entries.keys() == want.keys() and len(want) > len(toxicity.SEED)
    assert all(model.entries[e] == pytest.approx(want[e], rel=1e-9) for e in want)
    # the cut has the fewest errors on the sample
    points = [(_density(want, f), y) for f, y in sample]
    errors = lambda cut: sum((x >= cut) != y for x, y in points)
    assert errors(model.middle) == min(errors(c) for c in [0.05, *(x + 1e-9 for x, _ in points)])
    got = defaultdict(list)
    for r in toxicity.score_toxicity(docs, model).collect():
        got[r["doc_id"]].append((r["held_out"], r["score"], r["predicted"]))
    for i, own in texts.items():
        scores = sorted(1 / (1 + math.exp(-max(-30, min(30, toxicity.SHARPNESS * (_density(want, _fold(t)) - model.middle) / model.middle)))) for t in own)
        assert sorted(x[1] for x in got[i]) == pytest.approx(scores, rel=1e-9)
        assert all(held == (_crc(i, 5) == 0) and predicted == (score >= 0.5) for held, score, predicted in got[i])


def test_toxicity_of_many_matches_and_exceptions_takes_linear_time():
    import time

    machine = toxicity.Model({" trash ": 4.0, " zark": 2.0}, tuple(toxicity.EXCEPTIONS), 1.0).automaton()
    folded = toxicity.fold(["trash can zarkon trash " * 50_000])[0]
    began = time.process_time()
    assert toxicity.density(machine, folded) == pytest.approx(50_000 * 6.0 / (1 + math.log2(1 + folded.count(" ") / 100)))
    assert time.process_time() - began < 20


@pytest.mark.parametrize("text", ["trash can trash", "class clown fish stupid", "not stupid not worthless trash trash bin", "clown class clown fish clown"])
def test_exception_phrases_that_overlap(text):
    entries = {f" {w} ": 4.0 for w in toxicity.SEED}
    machine = toxicity.Model(entries, tuple(toxicity.EXCEPTIONS), 1.0).automaton()
    folded = toxicity.fold([text])[0]
    assert toxicity.density(machine, folded) == pytest.approx(_density(entries, folded))


# --- language -----------------------------------------------------------------------------------------------


def _vector(text):
    """Square roots of hashed n-gram counts, to unit length."""
    folded = [b | 0x20 if 65 <= b <= 90 else 32 if b < 97 or 123 <= b < 128 else b for b in text.encode()]
    out = np.zeros(langid.FEATURES)
    for n in langid.GRAMS:
        for k in range(len(folded) - n + 1):
            h = folded[k]
            for b in folded[k + 1 : k + n]:
                h = (h * 16777619 & 0xFFFFFFFF) ^ b
            out[((h + n) * int(langid._MIX[n - 1]) & 0xFFFFFFFF) >> (32 - langid.FEATURES.bit_length() + 1)] += 1
    out = np.sqrt(out)
    return out / (np.linalg.norm(out) or 1)


def _language_rows():
    rng = random.Random(4)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["schr", "ung", "keit"], "cc": ["éau", "oi", "çon"]}
    rows = []
    for k in range(150):
        lang = "abc"[min(k % 4, 2)] * 2
        rows.append((k, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randint(2, 12))), lang))
    return rows + [(500, None, "aa"), (501, "12", "bb"), (502, "Kalo SCHRUNG", None), (3, rows[3][1], rows[3][2])]


def test_language_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 60)
    rows = _language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    names = ["aa", "bb", "cc"]
    assert model.languages == tuple(names)
    # the least hashes of each language, by Spark's own hash
    place = {r["i"]: r["h"] for r in docs.selectExpr("doc_id AS i", "pmod(xxhash64(9, doc_id), 2147483648L) AS h").collect()}
    sample = []
    for name in names:
        own = sorted({(place[i], i, t) for i, t, lang in rows if lang == name and t and re.search(r"[^\W\d_]", t) and _crc(i, 3) != 1})
        sample += [(name, t) for _, _, t in own[:20]]
    x = np.stack([np.append(_vector(t), 1.0) for _, t in sample])
    at = np.array([names.index(n) for n, _ in sample])
    assert len(sample) == 60
    code = np.array([[1 if (k >> row) & 1 else -1 for k in range(1, 4)] for row in range(3)])
    # ridge of each bit in the primal form
    weight = len(at) / (3 * np.bincount(at, minlength=3)[at])
    solved = np.linalg.solve(x.T @ (weight[:, None] * x) + langid.RIDGE * np.eye(x.shape[1]), x.T @ (weight[:, None] * code[at]))
    assert np.abs(model.weights - solved).max() < 1e-3
    got = {(r["doc_id"]): r for r in langid.identify(docs, model).collect()}
    kept = {r["doc_id"] for r in langid.with_language(docs, model).collect()}
    for i, t, _ in rows:
        if not re.search(r"[^\W\d_]", t or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) and i not in kept
            continue
        margin = np.clip(np.append(_vector(t), 1.0) @ solved, -1.5, 1.5)
        loss = np.exp(-langid.LOSS * margin * code).mean(axis=1)
        score = 1 / np.exp(-(loss - loss.min())).sum()
        assert got[i]["lang_pred"] == names[int(loss.argmin())] and got[i]["score"] == pytest.approx(score, rel=1e-2)
        low, second = sorted(loss)[:2]
        if abs((second - low) / second - langid.LEAD) > 0.02 and abs(score - 0.4) > 0.01:
            assert (i in kept) == (second - low >= langid.LEAD * second or score >= 0.4)


def test_only_the_most_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 12)
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rows = [(10 * k + n, f"{name * 3} {name}x word{n}", name) for k, name in enumerate(["aa", "bb", "cc", "dd", "ee"]) for n in range(9 if name in ("bb", "dd", "ee") else 4)]
    model = langid.learn(spark.createDataFrame(rows * 3, "doc_id long, text string, lang string"))
    assert model.languages == ("bb", "dd", "ee")


# --- URLs ---------------------------------------------------------------------------------------------------

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _urls():
    rng = random.Random(11)
    rows = [(k, f"http://{rng.choice(['good', 'fine']) if k % 2 else rng.choice(['spam', 'junk'])}{rng.randint(0, 30)}.{'x.org/fr/' if k % 2 else 'y.net/'}p{k % 17}") for k in range(160)]
    return rows + [(k, f"https://{rng.choice(['good', 'spam', 'other'])}{k}.info/q{k}?a=b") for k in range(200, 230)] + [(300, None), (301, ""), (302, "no scheme"), (303, "HTTP://Spam1.Y.NET/"), (200, "https://good200.info/")]


def test_url_models_by_brute_force(spark, monkeypatch):
    rows = _urls()
    df = spark.createDataFrame(rows, "page_id long, url string")
    ruled = {}
    for i, u in rows:
        host = re.match(r"[^/?#]*", u.split("://", 1)[1])[0].lower() if u and "://" in u else ""
        ruled[i] = "allow" if host.endswith(".org") else "block" if host.endswith(".net") else None
    chars = {}
    for i, u in rows:
        if u is not None:
            chars[i, u] = ["\2"] * 3 + list(re.sub(r"^[^:/?#]*://", "", u).lower()) + ["\3"]
    counts = {side: [Counter() for _ in range(5)] for side in ("allow", "block")}
    kinds = {side: [Counter() for _ in range(5)] for side in ("allow", "block")}
    last = set()
    for i, u in rows:
        if u is not None and ruled[i] and _crc(i, 5):
            own = chars[i, u]
            for k in range(3, len(own)):
                last.add(own[k])
                for n in range(1, 5):
                    counts[ruled[i]][n][tuple(own[k - n + 1 : k + 1])] += 1
    for side in counts:
        for n in range(2, 5):
            for gram in counts[side][n]:
                kinds[side][n][gram[:-1]] += 1

    def p(side, gram):
        total = sum(counts[side][1].values())
        out = (counts[side][1][gram[-1:]] + 0.5) / (total + 0.5 * (len(last) + 1))
        for n in range(2, 5):
            context = gram[4 - n : 3]
            seen, new = sum(c for g, c in counts[side][n].items() if g[:-1] == context) if kinds[side][n][context] else 0, kinds[side][n][context]
            if seen:
                out = (counts[side][n][gram[4 - n :]] + new * out) / (seen + new)
        return out

    memo, score = {}, {}
    for (i, u), own in chars.items():
        total = 0.0
        for k in range(3, len(own)):
            gram = tuple(own[k - 3 : k + 1])
            if gram not in memo:
                memo[gram] = math.log(p("allow", gram)) - math.log(p("block", gram))
            total += memo[gram]
        score[i, u] = total / (len(own) - 3)
    for i, u in rows:
        score.setdefault((i, u), 0.0)
    held = [(score[i, u], ruled[i]) for i, u in rows if u is not None and ruled[i] and not _crc(i, 5)]

    def error(cut):
        return np.mean([x < cut for x, y in held if y == "allow"]) + np.mean([x >= cut for x, y in held if y == "block"])

    for bound in (500_000, 5):  # weights by broadcast, and by a join with split grams
        monkeypatch.setattr(urlfilter, "BROADCAST_GRAMS", bound)
        got = defaultdict(list)
        for r in urlfilter.judge_urls(df, RULES).collect():
            got[r["page_id"]].append((r["score"], r["verdict"]))
        for i in got:
            assert sorted(x for x, _ in got[i]) == pytest.approx(sorted(score[j, u] for j, u in rows if j == i), rel=1e-9, abs=1e-12)
        free = [x for i in got for x in got[i] if ruled[i] is None]
        low, high = max((x for x, v in free if v == "block"), default=-99), min(x for x, v in free if v == "allow")
        assert low < high and min(error(low + 1e-9), error(high)) <= min(error(x) for x, _ in held) + 1e-9


# --- pipeline -----------------------------------------------------------------------------------------------


def _shingles(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def _corpus():
    rng = random.Random(21)
    english = ["the", "of", "and", "house", "water", "green", "light", "stone", "river", "about", "people", "under", "little", "great", "always"]
    german = ["der", "und", "haus", "wasser", "grün", "licht", "stein", "fluss", "über", "leute", "unter", "klein", "groß", "immer", "nicht"]
    item = [f"question{k}" for k in range(30)]
    rows, labels = [], []
    for k in range(260):
        lang, words = ("en", english) if k % 2 else ("de", german)
        words = [f"{w}{rng.choice(['', 's', 'en'])}" for w in rng.choices(words, k=rng.randint(40, 90))]
        toxic = int(k % 9 == 0)
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["zarkon", "zarkish", "blemple"])
        if k % 13 == 5:
            words[10:10] = [w.title() + "," for w in item]
        rows.append((k, " ".join(words), lang, f"s{k % 3}", k))
        labels.append((k, toxic))
    for k in range(60):  # copies, exact and with one to twelve words changed
        _, text, lang, source, _ = rows[rng.randrange(260)]
        words = text.split()
        for _ in range(rng.choice([0, 1, 2, 12])):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(99)}"
        rows.append((300 + k, " ".join(words), lang, source, 0))
    rows += [(400, None, "en", None, None), (401, "", None, "s1", 1), (402, "12 34", "en", "s1", 1), (None, "a text without an id but with many words of the river and the house", "en", "s1", 1), (403, "the house", None, None, 1), (5, rows[5][1], "en", "s2", 7)]
    return rows, labels, [(1, " ".join(item)), (2, "never seen words of a test that no document holds")]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_by_brute_force(spark, tmp_path, empty):
    rows, labels, items = _corpus()
    rows = [] if empty else rows
    # columns whose names the stages use themselves
    names = ["doc_id", "text", "lang", "source", "n_chars", "k1", "c0", "score", "kept", "component_id", "_gone"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, k1 string, c0 string, score string, kept string, component_id string, _gone string"
    docs = spark.createDataFrame([(*r, "x", "y", "z", "k", "c", "g") for r in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, stages = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, str(tmp_path))
        assert after.columns == names
        after.write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        stages[name] = Counter((r["doc_id"], r["text"]) for r in left.collect())
        assert all(tuple(r)[5:] == ("x", "y", "z", "k", "c", "g") for r in left.collect())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if empty:
        assert not got and not any(stages.values())
        return
    held = Counter((r[0], r[1]) for r in rows)

    # toxicity: the lexicon learned from the labels, matched plainly
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = Counter({(i, t): n for (i, t), n in held.items() if _density(model.entries, _fold(t)) < model.middle})
    assert stages["toxicity"] == held and not any(i is not None and i < 260 and i % 9 == 0 for i, _ in held)

    # language: texts with letters that the model knows
    known = langid.learn(spark.read.parquet(f"{tmp_path}/toxicity"))
    code, kept = known.code, {}
    for i, t in held:
        if t and re.search(r"[^\W\d_]", t):
            loss = np.exp(-langid.LOSS * np.clip(_vector(t) @ known.weights[:-1] + known.weights[-1], -1.5, 1.5) * code).mean(axis=1)
            score, (low, second) = 1 / np.exp(-(loss - loss.min())).sum(), sorted(loss)[:2]
            if second - low >= langid.LEAD * second or score >= langid.LEAST_SHARE / 2:
                kept[i, t] = held[i, t]
    held = Counter(kept)
    assert stages["language"] == held and (400, None) not in held and (402, "12 34") not in held

    # near duplicates: the least id of each component of all pairs of 0.8 or more
    sets = {i: _shingles(re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) for i, t in held if i is not None}
    least = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            x = min(least[a], least[b])
            changed |= least[a] != x or least[b] != x
            least[a] = least[b] = x
    held = Counter({(i, t): n for (i, t), n in held.items() if i is None or least[i] == i})
    assert stages["near_duplicates"] == held and len(pairs) > 20

    # benchmark passages
    own = [_shingles(re.findall(r"[^\W_]+", t.lower())) for _, t in items]
    held = Counter({(i, t): n for (i, t), n in held.items() if not any(len(_shingles(re.findall(r"[^\W_]+", t.lower())) & s) >= 0.8 * len(s) for s in own)})
    assert stages["decontamination"] == held and not any(i is not None and i < 260 and i % 13 == 5 for i, _ in held)

    # ids of the whole texts
    library = Tokenizer.from_file(PATH)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter({(i, tuple(library.encode(t, add_special_tokens=False).ids)): n for (i, t), n in held.items()})


def test_stages_name_their_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "bpe"]
    assert neardup.collections(80) >= neardup.collections(85) and decontaminate.WIDTH == 5
