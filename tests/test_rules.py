import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from sardabir.functions import chars as C
from sardabir.functions import text as T
from sardabir.operators import markup, typography
from sardabir.plans import persianized

Z = "‌"
FINDER = typography.Finder()


def ids(text):
    return [h[4] for h in FINDER.hits(text)]


def test_golden_cases():
    assert ids("دري ")[-1:] == ["arabic_yeh"]
    assert "zwnj_mi" in ids("او می خواند و رفت")
    assert "zwnj_mi" not in ids("می کهنه خورد") and "zwnj_mi_other" in ids("می کهنه خورد")
    assert set(ids("مي خواند")) == {"arabic_yeh", "zwnj_mi"}
    assert ids("کتاب ها") == ["zwnj_ha"]
    assert ids("پس از از او") == ["repeated_word"]
    assert ids("كتاب ةة ي") == [] and ids("plain Latin, text") == []
    assert ids("سلام,دوست") == ["latin_comma"]
    assert ids(f"نا{Z}{Z}مه") == ["zwnj_duplicate"]
    assert ids("سلام ..") == []
    assert "latin_digits" not in ids("کتاب A1") and "latin_digits" in ids("کتاب 12")


def test_hits_are_ordered_and_do_not_overlap():
    rng = random.Random(3)
    letters = "ابمیهکيك" + Z * 2 + "  .,;?!\"0ـَة‌می ها تر از"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        hits = FINDER.hits(text)
        assert [h[0] for h in hits] == sorted(h[0] for h in hits)
        for off, n, orig, sugg, _ in hits:
            assert text[off:off + n] == orig and sugg != orig
        kept = [h for h in hits if h[4] not in typography.ONE_TO_ONE]
        for a, b in zip(kept, kept[1:]):
            assert a[0] + a[1] <= b[0]


def test_spark_patterns_equal_python(spark):
    rng = random.Random(5)
    letters = "ابمیهکيكن" + Z + "  .,;?!:\"07xـَةﻻ،؛"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for rule in typography.RULES:
        if not rule.when:
            pattern = re.compile(typography._python_form(rule.pattern))
            got = [r["h"] for r in df.select(typography.spans(F.col("t"), rule.pattern).alias("h")).collect()]
            assert [[(h["off"], h["orig"]) for h in hs] for hs in got] == [[(m.start(), m[0]) for m in pattern.finditer(t)] for t in texts], rule.id


def test_native_fixes_equal_those_in_markup(spark):
    rng = random.Random(7)
    letters = "ابمیهکيكن" + Z * 2 + "  .,;?!ﻻ٣"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 50))) for _ in range(200)] + ["سلام,دوست"]
    fixer = markup.Fixer()
    for row in typography.apply_safe(spark.createDataFrame([(t,) for t in texts], "t string")).collect():
        fixed, counts = fixer.markup(row["t"])
        assert (row["fixed"], row["fixes"]) == (fixed, counts)


def test_markup_keeps_tags_and_untouchables():
    fixer, tags = markup.Fixer(), re.compile(r"<[^>]*>")
    source = "<p>سلام, <b>مي</b> رود</p><pre>كتاب,</pre><!-- كتاب, --><code>ي</code><script>ي,</script>"
    fixed, counts = fixer.markup(source)
    assert tags.findall(fixed) == tags.findall(source) and "<pre>كتاب,</pre>" in fixed and "<script>ي,</script>" in fixed
    assert counts == {"latin_comma": 1, "arabic_yeh": 1}
    assert fixer.markup("") == ("", {})


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("سلام,", 3)], "t string, k int")
    assert [r["k"] for r in typography.find_issues(df).collect()] == [3]
    assert typography.find_issues(df.limit(0)).count() == 0
    assert T.presentation_map()["ﻻ"] == "لا" and len(C.PERSIAN_DIGITS) == 10


# hits of each rule over the Persian test text, as FIXTURES.md has them: sf0.001, sf0.01
EXPECTED = {
    "bom": (94, 478), "presentation_forms": (579, 3383), "arabic_yeh": (4612, 24030), "arabic_kaf": (1077, 5580), "other_heh": (104, 709), "arabic_digits": (91, 412),
    "latin_comma": (3935, 19393), "latin_question": (85, 444), "latin_semicolon": (255, 1045), "space_before_punct": (481, 2197), "space_after_punct": (328, 1447), "zwnj_duplicate": (120, 761),
    "zwnj_dangling": (2341, 15161), "zwnj_mi": (680, 2925), "zwnj_ha": (817, 3557), "zwnj_mi_other": (1606, 7613), "zwnj_tar": (462, 2027), "zwnj_after_heh": (156, 670),
    "repeated_word": (1277, 5809), "period_no_space": (3595, 17317), "tatweel": (489, 3704), "latin_digits": (25, 244), "latin_quotes": (343, 1635),
}


@pytest.mark.parametrize(("folder", "nth"), [("sf0.001", 0), ("sf0.01", 1)])
def test_hits_are_as_many_as_expected(spark, folder, nth):
    found = typography.find_issues(persianized.blocks(spark, f"/root/testdata/{folder}")).groupBy("rule").count().collect()
    assert {r["rule"]: r["count"] for r in found} == {rule: n[nth] for rule, n in EXPECTED.items()}


def naive_hits(text):
    """All hits of a block, by the definition: rule after rule, interval against interval."""
    letters, marks = [c for c in text if re.match(f"[{C.plain(C.LETTERS)}]", c)], [c for c in text if re.match(f"[{C.plain(C.MARKS)}]", c)]
    if not letters or len(marks) / len(letters) > 0.12 or text.count("ة") >= 2:
        return []
    fixes = {"ي": "ی", "ى": "ی", "ك": "ک", "ھ": "ه", "ە": "ه", **{chr(0x660 + k): chr(0x6F0 + k) for k in range(10)}}
    held, out = [], []
    for nth, rule in enumerate(typography.RULES):
        single = rule.id in typography.ONE_TO_ONE
        work = text if nth < 6 else "".join(fixes.get(c, c) for c in text)
        for m in re.finditer(typography._python_form(rule.pattern), work):
            s, e = m.span()
            if rule.when:
                beside = work[max(0, s - 2):s] + " " + work[e:e + 2] if rule.when == "persian_near" else m[1]
                if not re.search(f"[{C.plain(C.LETTERS)}]", beside) or re.search("[A-Za-z]", beside):
                    continue
            if any(a < e and s < b for a, b in held) and not single:
                continue
            new = fixes[m[0]] if single else unicodedata.normalize("NFKC", m[0]) if rule.put == "NFKC" else "".join(chr(0x6F0 + int(c)) for c in m[0]) if rule.put == "DIGITS" else m.expand(re.sub(r"\$(\d)", r"\\\1", rule.put))
            if new != m[0]:
                out.append((s, nth, e - s, text[s:e], new, rule.id))
                if not single:
                    held.append((s, e))
    return [(s, n, old, new, rule) for s, _, n, old, new, rule in sorted(out)]


def naive_safe(text, counts):
    if not re.search(f"[{C.plain(C.LETTERS)}]", text) or not FINDER.gated(text):
        return text
    for rule in typography.SAFE:
        out, at = "", 0
        for m in re.finditer(typography._python_form(rule.pattern), text):
            new = unicodedata.normalize("NFKC", m[0]) if rule.put == "NFKC" else "".join(chr(ord(c) + 0x90) for c in m[0]) if rule.put == "DIGITS" else m.expand(re.sub(r"\$(\d)", r"\\\1", rule.put))
            counts[rule.id] = counts.get(rule.id, 0) + (new != m[0])
            out, at = out + text[at:m.start()] + new, m.end()
        text = out + text[at:]
    return text


LETTERS = "ابمیهکيكنةر" + Z * 2 + "  .,;?!:\"\"07x٣ـَﻻ﻿،؛  "


def made_up(seed, n, longest):
    rng = random.Random(seed)
    words = ["می", "نمی", "ها", "های", "تر", "ام", "از از", "که", "كتاب", "خواند", "مي ", "«", '"متن"', "A1", "12"]
    return ["".join(rng.choice(words) + " " if rng.random() < 0.2 else rng.choice(LETTERS) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_hits_equal_the_definition(spark):
    texts = made_up(11, 800, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in typography.find_issues(df).collect():
        got.setdefault(r["k"], []).append((r["off"], r["len"], r["orig"], r["sugg"], r["rule"]))
    order = {r.id: n for n, r in enumerate(typography.RULES)}
    for k, text in enumerate(texts):
        assert sorted(got.get(k, []), key=lambda h: (h[0], order[h[4]])) == naive_hits(text), text


def test_fixes_equal_the_definition(spark):
    texts = made_up(12, 400, 60)
    for row in typography.apply_safe(spark.createDataFrame([(t,) for t in texts], "t string")).collect():
        counts = {}
        assert row["fixed"] == naive_safe(row["t"], counts) and row["fixes"] == {k: n for k, n in counts.items() if n}


def test_markup_equals_the_definition(spark):
    rng = random.Random(13)
    pages = []
    for texts in zip(*[iter(made_up(14, 900, 30))] * 6):
        tags = rng.choices(["<p>", "</p>", "<b class='كتاب,'>", "</b>", "<br/>", "<pre>", "</pre>", "<svg:rect/>", "<code>", "</code>", "<!-- كتاب, -->", "<script>", "</script>", "<?x مي ,?>"], k=6)
        pages.append("".join(t.replace("<", "") + tag for t, tag in zip(texts, tags)))
    df = spark.createDataFrame(list(enumerate(pages)), "k int, html string")
    for row in markup.fix_markup(df).collect():
        want, counts, depth = "", {}, 0
        for n, part in enumerate(re.split(r"(<!--.*?-->|<\?.*?\?>|<[^>]+>)", pages[row["k"]])):
            if n % 2:
                name = re.match(r"<(/?)(\w+)", part)
                if name and name[2] in ("pre", "code", "script") and not part.endswith("/>"):
                    depth = max(0, depth + (-1 if name[1] else 1))
            want += part if n % 2 or depth or not part.strip() else naive_safe(part, counts)
        assert (row["fixed"], row["fixes"]) == (want, {k: n for k, n in counts.items() if n})


def test_long_blocks_take_time_in_proportion(spark):
    def took(n):
        df = spark.createDataFrame([("کتاب خوب است, " * (n // 3),)], "t string")
        best = 1e9
        for _ in range(3):
            began = time.time()
            assert df.select(F.size(typography.spans(F.col("t"), C.WORD_RUN)).alias("n")).first()["n"] == n // 3 * 3
            best = min(best, time.time() - began)
        return best

    took(300)
    assert took(48_000) < 3.5 * took(24_000)
