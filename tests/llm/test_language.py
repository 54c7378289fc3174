import math
import random

import numpy as np
import pytest

from loglark.llm import language, queries

WORDS = {"en": ["the", "and", "thing", "of"], "de": ["der", "und", "nicht", "schön"], "xx": ["qua", "zix", "vol", "pom"]}


def say(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(16)
    docs = [(say(rng, lang, rng.randint(5, 60)), lang) for lang in ("en", "en", "de", "xx") for _ in range(40)] + [("lost", None), (None, "de")]
    rows = []
    for i in range(120):
        lang = ("en", "de", "xx")[i % 3]
        host = f"{'www.' if i % 2 else ''}{lang}-site{i % 5}.{'de' if lang == 'de' else 'example'}"
        html = f'<html lang="{lang}"><script>the and the</script><p>{say(rng, lang, rng.randint(0, 12) * 5)}</p></html>'
        rows.append((i, f"https://{host}/{i}", html))
    # No text: the host knows. No host, no text: the markup knows. Nothing at all. A wrong declaration against much text.
    rows += [(500, "http://de-site1.de/x", "<p></p>"), (501, None, '<HTML dir=ltr lang=de-AT><p></p>'), (502, "not an address", None),
             (503, "http://other.example/en/", '<html lang="en">' + say(rng, "de", 200)), (502, "not an address", None),
             (None, "http://u:p@de-site1.de:80/", "")]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, language string")
    return pages, spark.createDataFrame(docs, "text string, lang string"), rows, docs


def test_languages(tables):
    pages, training, rows, _ = tables
    found = language.identify(pages, training).collect()
    assert len(found) == len(rows) and all(0 < r.probability <= 1 for r in found)
    got = {r.page_id: r for r in found}
    for i in range(120):
        assert got[i].language == ("en", "de", "xx")[i % 3]
    assert got[500].language == "de" and got[500].text_language is None and got[500].host == "de-site1.de"
    assert got[501].language == "de" and got[501].declared == "de"
    assert got[502].host is None and got[502].declared is None and got[502].language in WORDS
    assert got[503].language == "de" and got[503].declared == "en"
    assert got[None].language == "de" and got[None].host == "de-site1.de"


def test_visible_text():
    page = b"<!-- the --><p class='x'>One</p><SCRIPT>var a='<p>';</SCRIPT ><style>b{}</style>two"
    assert language.visible(page).split() == [b"One", b"two"]


def plain_counts(docs, names):
    out = np.zeros((len(names), language.BUCKETS), np.int64)
    for text, lang in docs:
        if lang is not None:
            for found in language._buckets((text or "").encode()):
                np.add.at(out[names.index(lang)], found, 1)
    return out


def test_posterior_against_a_plain_version(spark, tables):
    pages, training, rows, docs = tables
    names = ["de", "en", "xx"]
    counts = plain_counts(docs, names)
    assert np.array_equal(language.counts_by_language(training, names, "lang", "text"), counts)
    weights = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * language.BUCKETS))
    import re

    def evidence(url, html):
        ll = np.zeros(3)
        for found in language._buckets(language.visible((html or "").encode())):
            for b in found:
                ll += weights[:, b] * language.TEXT_WEIGHT
        host = re.match(r"[a-z]+://(?:[^/@]*@)?([^/:]+)", url or "")
        host = host[1] if host else None
        code = re.match(r"[a-z]+://[^/]*/([a-z]{2})(?:[/?#-]|$)", url or "")
        declared = re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", html or "")
        labels = host.split(".") if host else []
        hint = "/".join([labels[-1]] + ([code[1]] if code else [])) if host else None
        return ll, declared[1].lower() if declared else None, hint, labels[-1] if host else None, ".".join(labels[-2:]) or None, host

    found = [evidence(u, h) for _, u, h in rows]
    shares = []
    for e in found:
        p = np.exp(e[0] - e[0].max())
        shares.append(p / p.sum() * (1 - language.DOUBT) + language.DOUBT / 3)
    total = sum(shares)
    prior = (total + 1) / (total.sum() + 3)
    want = []
    for i, e in enumerate(found):
        post = e[0].copy()
        for k in (1, 2):
            if e[k] is not None:
                same = sum(s for s, o in zip(shares, found) if o[k] == e[k])
                of_all = sum(s for s, o in zip(shares, found) if o[k] is not None)
                kinds = len({o[k] for o in found if o[k] is not None}) + 1
                post += np.log((same + 0.5) / (of_all + 0.5 * kinds))
        p = prior
        for k in (3, 4, 5):
            others = sum((s for j, (s, o) in enumerate(zip(shares, found)) if e[k] is not None and o[k] == e[k] and j != i), np.zeros(3))
            p = (others + language.STRENGTH * p) / (others.sum() + language.STRENGTH)
        post += np.log(p)
        q = np.exp(post - post.max())
        want.append((str(rows[i][0]), names[int(np.argmax(post))], float((q / q.sum()).max())))
    got = sorted((str(r.page_id), r.language, r.probability) for r in language.identify(pages, training).collect())
    for a, b in zip(got, sorted(want)):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-6, abs_tol=1e-9)


def test_declaration_after_much_else(spark, tables):
    """A long comment before the tag, and a tag across the 4 096th character."""
    _, training, _, _ = tables
    tag = '<html class="no-js" lang="de">'
    rows = [(1, f"<!-- {'licence ' * 625}-->{tag}"), (2, " " * 4080 + tag), (3, "<!doctype html>\n" * 20_000 + tag), (4, " " * 5000)]
    pages = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string")
    got = {r.page_id: r.declared for r in language.identify(pages, training).collect()}
    assert got == {1: "de", 2: "de", 3: "de", 4: None}


def test_nothing_to_learn_from_and_empty_tables(tables):
    pages, training, rows, _ = tables
    got = language.identify(pages, training.where("lang IS NULL"))
    assert got.count() == len(rows) and got.where("language IS NOT NULL").count() == 0
    assert language.identify(pages.where("page_id = 1000"), training).count() == 0


def test_query(spark, sf):
    rows = queries.op4_language(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert np.mean([r.language == r.declared for r in rows]) > 0.95
