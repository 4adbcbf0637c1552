import random
from collections import defaultdict

from textloom.llm.site_lines import mark_repeated, without_repeated

SCHEMA = "web_id long, url string, domain string, content string, site string, line string"


def brute(rows, least=5):
    def site(domain, url):
        name = domain if domain is not None else (url.split("//")[1].split("/")[0] if url else None)
        name = (name or "").strip().lower()
        for lead in ("www.", "m."):
            while name.startswith(lead):
                name = name[len(lead) :]
        return name

    letters = lambda s: "".join(c for c in s.lower() if c.isalpha())
    urls = defaultdict(set)
    for _, url, domain, content, *_ in rows:
        for line in (content or "").split("\n"):
            if letters(line):
                urls[site(domain, url), letters(line)].add(url)
    return {
        (web_id, n)
        for web_id, url, domain, content, *_ in rows
        if content is not None
        for n, line in enumerate(content.split("\n"), 1)
        if letters(line) and len(urls[site(domain, url), letters(line)]) >= least
    }


def pages(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        host = rng.choice(["a.test", "www.A.test", "m.a.test", "b.test"])
        lines = [rng.choice(["Home", "HOME!", "© 2025 Über uns", "", "123", f"own {i}", "Read more »", f"rare {i % 40}"]) for _ in range(rng.randint(0, 8))]
        out.append((i, f"https://{host.lower()}/{i % (n - 20)}", rng.choice([host, None]), rng.choice(["\n", "\r\n"]).join(lines), "s", "l"))
    return out


def test_against_brute_force(spark):
    rows = pages(300, 1)
    got = mark_repeated(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_pruned_summaries_lose_no_line(spark):
    """With room for a handful of counters nearly everything is pruned, and the exact pass makes good for it."""
    rows = pages(300, 2)
    got = mark_repeated(spark.createDataFrame(rows, SCHEMA).repartition(3), size=4)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_cleaned_pages(spark):
    rows = pages(60, 3) + [(900, "https://a.test/x", None, None, "s", "l"), (901, None, None, "Home\nown", "s", "l"), (902, "https://a.test/y", "a.test", "", "s", "l")]
    df = spark.createDataFrame(rows, SCHEMA)
    gone = brute(rows)
    for r in without_repeated(df).collect():
        source = next(x for x in rows if x[0] == r.web_id)[3]
        kept = None if source is None else "\n".join(line for n, line in enumerate(source.split("\n"), 1) if (r.web_id, n) not in gone)
        assert r.content == kept and r.removed_lines == sum(w == r.web_id for w, _ in gone)


def test_empty(spark):
    assert mark_repeated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_and_shared_ids(spark):
    own = [chr(97 + i) * 5 for i in range(12)]
    rows = [(None if i % 2 else 7, f"https://a.test/{i}", "a.test", f"Home\n{w}" if i % 3 else f"{w}\nHome", "s", "l") for i, w in enumerate(own)]
    got = without_repeated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.content for r in got) == own and all(r.removed_lines == 1 for r in got)
