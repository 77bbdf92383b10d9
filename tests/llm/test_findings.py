"""What the operators once left out: near copies under 85 % in the pipeline, scripts with `<`, many people in one text."""

import re

import corpus_pipeline
import pytest

from sardabir.llm import html_text, neardup, pii, shingles


def test_the_pipeline_links_near_copies_from_80_percent_on(spark):
    texts, gone = [], set()
    for pair, n in enumerate([*range(44, 62)] * 12):
        words = [f"w{pair}x{k}" for k in range(n)]
        # one word changed well inside: five of n - 4 shingles differ
        texts += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join([*words[:20], "changed", *words[21:]]))]
        if 100 * (n - 9) >= 80 * (n + 1):
            gone.add(2 * pair + 1)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, "").collect()} == {k for k, _ in texts} - gone
    assert len(gone) == 13 * 12 and neardup.drop_copies(docs).count() == len(texts)


@pytest.mark.parametrize("percent", [30, 50, 80, 85, 95, 100])
def test_bands_follow_from_the_bar(percent):
    at, s = neardup.bars(percent), percent / 100
    assert (1 - s**at.band_rows)**at.bands <= 5e-8 and at.bands * at.band_rows <= neardup.HASHES
    assert at.least_estimate <= s and (percent != 80 or at.least_estimate <= 0.55)


SCRIPTS = [
    "<script>for(var i=0;i<n;i++){x[i]=1}</script>", "<SCRIPT type='a'>if(a<b){s=1}</Script >", "<script>s='<!-- <p';</script>", "<style>a<b{}</style>",
    "<title>a <b</title>", "<head><script>if(i<n)s='</head>';</script><title>x<y</title></head>", "<svg><style>a<b{}</style><path d='</svg>'></svg>",
    "<noscript><script>i<n</script></noscript>", "<head><script>s='</head>'</script>", "<head><!-- </head> --><script>i<n</script></head>", "<script>i<n</scripts></script>",
]


@pytest.mark.parametrize("script", SCRIPTS)
def test_markup_in_scripts_swallows_nothing(script):
    read = lambda source: "".join(text for _, text in html_text.Page(source).texts)
    assert read(f"{script}<article><p>one</p>{script}<p>two</p></article>three") == "onetwothree"
    assert read("<p>one</p><script>i<n</p>two") == "one" and read("<p>one<option>two<option>three</p>") == "onetwothree"


KEY = b"k" * 16
CYRILLIC, PERSIAN = "\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437\u0438\u043a", "\u0628\u067e\u062a\u0633\u0634\u0641\u06a9\u0644\u0645\u0646"


@pytest.mark.parametrize(("title", "digits", "first", "pairs"), [("Mr", "abcdefghij", "T", False), ("Mrs", "abcdefghij", "T", True), (list(pii.TITLES)[-4], CYRILLIC, "\u0422", False), (list(pii.TITLES)[-3], CYRILLIC, "\u0422", True), (list(pii.TITLES)[-2], PERSIAN, "\u0628", False), (list(pii.TITLES)[-1], PERSIAN, "\u0628", True)])
def test_many_people_in_one_text_stay_distinct(title, digits, first, pairs):
    people = [first + "".join(digits[int(d)] for d in f"{k:03d}") for k in range(700)]
    people = [f"{p} {q}" for p, q in zip(people, people[1:])] if pairs else people
    text = ", ".join(f"{title} {p}" for p in people + people[:50])
    new, found = pii.pseudonymize(text, KEY)
    names = [re.sub(f"^{title} ", "", part) for part in new.split(", ")]
    assert len(found) == len(people) + 50 and len(set(names)) == len(people) and names[:50] == names[-50:]
    assert not set(names) & set(people) and [k for _, _, k in pii.find_entities(new)] == ["name"] * len(found)


def test_short_emails_and_secrets_stay_distinct():
    letters = "abcdefghijklmnopqrstuvwxyz"
    emails = [f"{a}@{b}.com" for a in letters for b in letters]
    new = pii.pseudonymize(" ".join(emails), KEY)[0].split()
    assert len(set(new)) == len(emails) and not set(new) & set(emails)
    assert pii.pseudonymize("token = ++++++++", KEY)[0] != "token = ++++++++"


def test_a_person_has_one_name_wherever_it_stands():
    text = "Mr John Smith met Mrs Jane Smith. Mr Smith and John Smith left, SMITH's dog stayed. Dr. Ada Byron and Herr Prof. Dr. Weiss; Byron, Smithers, Jane."
    new, found = pii.pseudonymize(text, KEY)
    m = re.fullmatch(r"Mr (\w+) (\w+) met Mrs (\w+) (\w+)\. Mr (\w+) and (\w+) (\w+) left, (\w+)'s dog stayed\. Dr\. (\w+) (\w+) and Herr Prof\. Dr\. (\w+); (\w+), Smithers, (\w+)\.", new)
    john, smith, jane, _, _, _, _, _, ada, byron, weiss, _, _ = m.groups()
    assert m.groups() == (john, smith, jane, smith, smith, john, smith, smith, ada, byron, weiss, byron, jane) and len({john, smith, jane, ada, byron, weiss}) == 6
    assert not {"john", "smith", "jane", "ada", "byron", "weiss"} & {w.lower() for w in m.groups()} and len(found) == 9
    persian = list(pii.TITLES)[-2]
    name, said = "\u0631\u0636\u0627", "\u06af\u0641\u062a"
    assert pii.pseudonymize(f"{persian} {name} {said}. x {said}. {name}", KEY)[0].count(said) == 1


def test_emails_of_any_length_are_replaced_whole():
    for local in ("a" * 79, "head." + "b" * 80, "head." + "b.c-" * 5_000 + "d"):
        assert pii.find_entities(f"x {local}@{'e' * 300}.example.com, y") == [(2, 2 + len(local) + 313, "email")]
    assert pii.find_entities("a@b.com@c.de") == [(0, 7, "email")] and pii.find_entities("@" * 9_000) == []


def test_links_of_short_texts_do_not_depend_on_an_estimate():
    # 6 of 7 shingles in common, and estimates of 0.615 and 0.625
    for k in (288927, 408913, 593712, 6897, 131761):
        words = [f"{k}{c}" for c in "abcdefghijk"]
        sets = shingles.shingle_sets([" ".join(words), " ".join(words[:10]), " ".join(words[:8])])
        assert neardup._links([5, 3, 4], [0, 0, 0], [5, 3, 4], sets, 85) == [(5, 3)]
        assert neardup._links([5, 3, 4], [0, 1, 1], [5, 3, 4], sets, 60) == [(5, 3)]
