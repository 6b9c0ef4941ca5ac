import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tallyrank.llm import url_filter as uf


def split(url):
    if url is None or "://" not in url:
        return "", ""
    after = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", after).group()
    path = re.match(r"[^?#]*", after[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fit = [(h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


def shape(path):
    def one(s):
        for pattern, name in uf.SHAPES:
            if m := re.fullmatch(rf"(?:{pattern})(\.[A-Za-z0-9]{{1,5}})?", s, re.A):
                return name + (m[1] or "")
        return s

    parts = [one(s) for s in path.split("/")[1:]]
    return tuple(parts[: uf.MAX_DEPTH] + ["**"] * (len(parts) > uf.MAX_DEPTH))


def slow(rows, labels):
    bad = defaultdict(int)
    for i, b in labels:
        bad[i] = max(bad[i], b)
    seen = []
    for i, url in rows:
        host, path = split(url)
        name, verdict = rule(host, path)
        label = {"block": 1, "allow": 0}.get(verdict, bad.get(i))
        seen.append((i, host, path, name, verdict, shape(path), label))
    template = {(h, s): "" for _, h, _, _, _, s, _ in seen}
    for d in range(max((len(s) for _, s in template), default=0)):
        count = defaultdict(lambda: [0, 0, 0])
        for _, h, _, _, _, s, label in seen:
            if len(s) > d:
                c = count[h, template[h, s], s[d]]
                c[0] += 1
                c[1] += label is not None
                c[2] += label or 0
        new = {}
        for (h, s), t in template.items():
            if len(s) <= d:
                new[h, s] = t
                continue
            family = [v for (a, b, _), v in count.items() if (a, b) == (h, t)]
            n, lab, b = count[h, t, s[d]]
            all_n, all_lab, all_b = map(sum, zip(*family))
            name, rest = s[d], all_lab - lab
            if not (name.startswith("{") or name in ("**", "")):
                rare = len(family) > uf.MAX_CHILDREN and n < uf.MIN_CHILD_SHARE * all_n
                p = all_b / all_lab if all_lab else 0
                same = lab >= uf.MIN_LABELS and rest >= uf.MIN_LABELS and abs(b / lab - (all_b - b) / rest) <= uf.SAME_BELOW_Z * (p * (1 - p) * (1 / lab + 1 / rest)) ** 0.5
                name = "*" if rare or same else name
            new[h, s] = f"{t}/{name}"
        template = new
    total = defaultdict(lambda: [0, 0])
    for _, h, _, _, _, s, label in seen:
        total[h, template[h, s]][0] += label is not None
        total[h, template[h, s]][1] += label or 0
    out = []
    for i, h, p, name, verdict, s, _ in seen:
        n, b = total[h, template[h, s]]
        purity = (b + uf.PRIOR_LABELS * uf.PRIOR_BAD) / (n + uf.PRIOR_LABELS)
        out.append((i, h, p, name, verdict or ("block" if purity >= uf.REJECT_AT else "allow"), template[h, s], round(purity, 9), n))
    return sorted(out, key=str)


def fixture():
    r = random.Random(4)
    rows = [(i, f"http://{r.choice(['a.test', 'a.test', 'a.test', 'a.test', 'b.test', 'b.test', 'X.Example.com', 'example.net', 'sub.b.org'])}/{r.choice(['en', 'de', 'es', 'shop', 'blog'])}/{r.choice(['', 'x/', 'y/'])}{r.randrange(900)}{r.choice(['', '.html', '/', '?q=/en/', '#a'])}") for i in range(1000)]
    rows += [(3000 + i, f"https://many.test/t{r.choice('abcdefghij')}{r.choice('klmnopqrst')}/page") for i in range(300)]
    labels = [(i, int("/shop/" in u or r.random() < 0.1)) for i, u in rows if "a.test" in u] + [(i, int(r.random() < 0.3)) for i, u in rows if "b.test" in u] + [(5, 1), (5, 0), (9999, 1), (None, 1)]
    odd = ["ftp://EN.ORG/es/", "http://com/en/x", "http://.com/en/x", "http://notcom/en/x", "http://example.com/en/7", "http://a.example.com/en/70/x", "http://example.net/de/8", None, "", "no scheme /en/", "a://b://c/d", "http://h?x=/en/", "http://h#f", "http://h/a/b/c/d/e/f/g/h/i/j/k", "http://h//", "http://ü.com/en/É", "x\n://com/en/\ny?z", "http://h/2024-01-02/0123456789abcdef.tar/123e4567-e89b-12d3-a456-426614174000/item-12-345-678"]
    rows += [(2000 + i, u) for i, u in enumerate(odd)] + [(None, "http://a.test/shop/1"), (3, rows[3][1])]
    return rows, labels


def test_against_brute_force(spark):
    rows, labels = fixture()
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))
    given = spark.createDataFrame(labels, "page_id long, bad int").withColumn("l_id", F.lit(1))
    got = sorted(((*r[:6], round(r.purity, 9), r.n_labels) for r in uf.judge_urls(pages, given).collect()), key=str)
    want = slow(rows, [x for x in labels if x[0] is not None])
    assert got == want
    assert any(x[3] is None and x[4] == "block" for x in got) and any(x[5].startswith("/*") for x in got)


def test_without_labels_and_empty(spark):
    rows, _ = fixture()
    pages = spark.createDataFrame(rows, "page_id long, url string")
    assert uf.judge_urls(pages).count() == len(rows)
    assert uf.judge_urls(pages.limit(0), spark.createDataFrame([], "page_id long, bad int")).count() == 0


def test_plan_is_native(spark):
    rows, _ = fixture()
    plan = uf.judge_urls(spark.createDataFrame(rows, "page_id long, url string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_labelled_sections_below_the_share(spark):
    # 100 sections of one hundredth each, ten of them bad throughout; 60 more with one page and no label.
    urls = [(100 * s + i, f"http://hot.test/s{chr(97 + s // 10)}{chr(97 + s % 10)}/page") for s in range(100) for i in range(100)]
    urls += [(20000 + s, f"http://hot.test/r{chr(97 + s // 10)}{chr(97 + s % 10)}/page") for s in range(60)]
    labels = [(i, int(i < 1000)) for i, _ in urls if i < 10000]
    got = uf.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == set(range(1000))
    assert {r.template for r in got if r.page_id >= 20000} == {"/*/page"}
    few = [x for x in urls if x[0] < 2000]
    assert {r.page_id for r in uf.judge_urls(spark.createDataFrame(few, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect() if r.verdict == "block"} == set(range(1000))


def test_branches_below_the_named_levels(spark):
    top = "http://deep.test/a/b/c/d/e/f/g/h"
    tails = {"bad/x": 1, "good/x": 0, "mid/k/l/u": 1, "mid/k/l/v": 0}
    urls = [(100 * k + i, f"{top}/{t}/p") for k, t in enumerate(tails) for i in range(50)] + [(900, "http://deep.test/z/b/c/d/e/f/g/h/i/j")]
    labels = [(100 * k + i, bad) for k, bad in enumerate(tails.values()) for i in range(50)]
    got = uf.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == {100 * k + i for k in (0, 2) for i in range(50)}
    by = {r.page_id: r.template for r in got}
    assert by[0].endswith("/h/bad/x/p") and by[900] == "/z/b/c/d/e/f/g/h/**"


def test_named_levels_change_no_verdict(spark, monkeypatch):
    r = random.Random(7)
    urls = [(i, "http://h.test/" + "/".join(r.choice("abc") for _ in range(r.randrange(1, 6)))) for i in range(1200)]
    labels = [(i, int(r.random() < (0.95 if "/b/c" in u else 0.1))) for i, u in urls if r.random() < 0.5 and "/a/a/" not in u]
    monkeypatch.setattr(uf, "MAX_DEPTH", 1 << 20)
    want = [x if x[7] else (*x[:5], None, *x[6:]) for x in slow(urls, labels)]
    monkeypatch.setattr(uf, "MAX_DEPTH", 2)
    got = uf.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()
    assert sorted(((*x[:5], x.template if x.n_labels else None, round(x.purity, 9), x.n_labels) for x in got), key=str) == sorted(want, key=str)
    assert {x.verdict for x in got} == {"block", "allow"} and any(x.template.endswith("/**") for x in got)


def test_rules_left_out(spark):
    urls = [(i, f"http://a.example.com/en/{i}") for i in range(60)] + [(100 + i, f"http://a.example.com/en/7{i:02d}x") for i in range(5)] + [(200 + i, f"http://b.net/de/{i}") for i in range(9)]
    got = {(r.rule, r.learnt): r.n for r in uf.rules_left_out(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    # Without com/en/ its pages have no label but the few of example.com/en/7, which allow; without net/de/ there is none.
    assert got == {("com/en/", "allow"): 59, ("net/de/", "allow"): 9}


def test_rules_of_the_contract(spark):
    words = {"http://b.com/en/1": "block", "http://example.com/en/7": "allow", "http://b.net/de/1": "allow", "http://example.net/de/8": "block", "http://b.org/es/1": "block"}
    pages = spark.createDataFrame(list(enumerate(words)), "page_id long, url string")
    assert {r.page_id: (r.rule is not None, r.verdict) for r in uf.judge_urls(pages).collect()} == {i: (True, v) for i, v in enumerate(words.values())}
