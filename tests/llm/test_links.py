"""Url filters, phrases and token alignment against brute force and edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from flowloom.llm import alignment, phrases, url_filter
from flowloom.llm import queries as q

SF = "/root/testdata/sf0.001"
CLASH = ", __id string, __text string, at string, label string, pair string, word string, f string"


def rules_of(spark, rules):
    return spark.createDataFrame(rules, "action string, host string, path string")


def test_rules_by_longest_host_and_path(spark):
    urls = ["http://A.Net/x", "https://example.net/en/1?q", "http://b.example.net/de/", "http://xexample.net/en/", "http://example.com/de/a", "http://example.com/d", "http://x.org/fr/#t", "http://org/fr/",
            "http://net?x", "nothing", None, "http://", "http:///path", "ftp://user@c.net:80/en/", "x://y.net/a://b", "http://É.net/x", "http://a.net/en/\n"]
    rules = q.URL_RULES
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    for r in url_filter.judge(pages, rules_of(spark, rules)).collect():
        u = urls[r["page_id"]]
        host = path = ""
        if u and "://" in u:
            after = u.split("://", 1)[1]
            host = after
            for c in "/?#":
                host = host.split(c)[0]
            path = after[len(host) :].split("?")[0].split("#")[0]
            host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = sorted((-len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p))
        assert (r["host"], r["path"], r["rule"]) == (host, path, fit[0][1] if fit else None), u
        if fit:
            assert r["verdict"] == fit[0][2]


def test_aliases_share_decisions(spark):
    """Links and redirects join addresses, also through ones that no page has; an allowed one protects its aliases."""
    link = lambda u: f'<p>x<LINK rel="canonical" href="{u}"><p>'
    rows = [
        (1, "http://clean.example/a", link("http://bad.net/z")),
        (2, "http://www.clean.example/a/", None),
        (3, "http://other.example/b", '<meta http-equiv="refresh" content="0; url=https://mid.example/m">'),
        (4, "http://far.example/c?utm_source=x", None),
        (5, "http://safe.example/d", link("//good.example/ok/1")),
        (6, "http://m.safe.example/d.html", link("http://bad.net/y")),
        (7, "http://alone.example/e", "<link rel=stylesheet href=http://bad.net/css>"),
        (8, "http://alone.example/e?page=2", link("relative/path")),
        (9, "http://rooted.example/r", link("/s")),
        (10, "http://rooted.example/s", link("http://bad.net/q?a=1&amp;b=2")),
        (11, None, link("http://bad.net/")),
        (12, "http://bad.net/direct", None),
        (12, "http://bad.net/direct", None),
    ]
    pages = spark.createDataFrame([(*r, *["z"] * 7) for r in rows], "page_id long, url string, html string" + CLASH)
    redirects = spark.createDataFrame([("https://mid.example/m", "http://far.example/c#x"), ("http://far.example/c", "http://bad.net/w"), (None, "http://bad.net"), ("x", "y")], "from_url string, to_url string")
    rules = rules_of(spark, [("block", "bad.net", ""), ("allow", "GOOD.example", "/ok/"), (None, "alone.example", ""), ("block", None, "/")])
    got = url_filter.judge(pages, rules, redirects).collect()
    verdicts = {r["page_id"]: r["verdict"] for r in got}
    assert len(got) == len(rows)
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "block", 11: "allow", 12: "block"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert {r["rule"] for r in url_filter.judge(pages, rules, html_col=None).collect()} == {None, "bad.net"}


def plain_phrases(rows, least, top=2000, covered=80):
    f = defaultdict(Counter)
    for text, lang in rows:
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        n = sum(v for p, v in counts.items() if len(p) == 1)
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        drop = {p[i : i + k] for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= covered * counts[p[i : i + k]]}
        kept = []
        for p, a in cand.items():
            if p not in drop:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n, -s))
    return out


@pytest.mark.parametrize("bounds", [{}, {"HELD": 40, "GROWN": 60, "SHARES": 6}, {"HELD": 3, "GROWN": 1, "SHARES": 2}])
def test_phrases_equal_brute_force(spark, monkeypatch, bounds):
    rnd = random.Random(4)
    for k, v in bounds.items():
        monkeypatch.setattr(phrases, k, v)
    letters = ["the", "The", "of", "a", "b\x01", "b", "c", "É", "é", "\x85", "x y z", "cut,", "end.\n", "\t", "  ", "漢", "🙂!", "1:2"]
    rows = [(" ".join(rnd.choices(letters, [9, 5, 7] + [2] * 15, k=rnd.randint(0, 60))), rnd.choice(["en", "de", None])) for _ in range(150)] + [(None, "en"), ("", None), ("a " * 3000, "en"), ("hot pair " * 200, "de")]
    df = spark.createDataFrame([(i, t, lang, *["z"] * 7) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string" + CLASH).repartition(7)
    for least, top in ((4, 2000), (30, 5)):
        got = [tuple(r) for r in phrases.mine(df, least, top).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_phrases(rows, least, top)
    assert phrases.mine(df.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    words = spark.createDataFrame([("en", "a", 9 * 10**18), ("en", "b", 10**15), ("en", None, 9 * 10**18 + 10**15)], "lang string, word string, f long")
    found = spark.createDataFrame([("en", "a b", 2, 10**15)], "lang string, phrase string, words int, f long")
    made = phrases.ranked(found, words, 2000, 80).first()
    assert made["score"] == 2000000 * 10**15 // (9 * 10**18 + 10**15)


def plain_alignment(texts):
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    sign = lambda s: bytes([int(s[3:5], 16)]) if len(s) == 6 and s.startswith("<0x") else s.replace("▁", " ").encode()
    docs, held = [], Counter()
    for t in texts:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        xb, yb = [bytes(letters[c] for c in a.id_to_token(i)) for i in x], [sign(b.id_to_piece(i)) for i in y]
        groups = []
        if t and b"".join(xb) == b"".join(yb) == (" " + t).encode():
            cuts = sorted(set(np.cumsum([len(z) for z in xb]).tolist()) & set(np.cumsum([len(z) for z in yb]).tolist()))
            i = j = at = bt = 0
            for cut in cuts:
                gx, gy = [], []
                while at < cut:
                    at += len(xb[i])
                    gx.append(x[i])
                    i += 1
                while bt < cut:
                    bt += len(yb[j])
                    gy.append(y[j])
                    j += 1
                groups.append((gx, gy))
        links = [(p, r) for gx, gy in groups for p in gx for r in gy]
        held.update(set(links))
        docs.append((groups, links))
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    for groups, links in docs:
        text = ";".join(",".join(map(str, gx)) + "|" + ",".join(map(str, gy)) for gx, gy in groups)
        yield (
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        )


@pytest.mark.parametrize("bounds", [{}, {"SLICE": 60, "SUMMED": 50}])
def test_alignment_equals_brute_force(spark, monkeypatch, bounds):
    for k, v in bounds.items():
        monkeypatch.setattr(alignment, k, v)
    rnd = random.Random(2)
    bits = ["the", " the", "ing", "Ünï", "漢字", "🙂", "\n", "\n\n", "\t", " ", "  ", "'s", "don't", "<|endoftext|>", "<s>", "</s>", "<0x41>", "▁", "\x01", "\u00a0", "é́", "12345", "3.14", "...", "ﬁ", "Ⅷ", "\u3000", "\x00", "word", "unhappiness", "\u2028", "#@!"]
    texts = ["".join(rnd.choice(bits) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 25))) for _ in range(250)]
    texts += [" ".join(rnd.choice(["the", "internationalisation", "of", "café", "x1"]) for _ in range(rnd.randint(1, 30))) for _ in range(60)]
    texts += ["", None, " ", "  ", "a", "a ", " a", "x" * 20_000, "a  b", "same text", "same text"]
    if not bounds:
        texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, *["z"] * 7) for i, t in enumerate(texts)], "doc_id long, text string" + CLASH).repartition(5)
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    want = list(plain_alignment(texts))
    got = alignment.align_texts(df, *paths).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == want[r["doc_id"]], texts[r["doc_id"]]
    if not bounds:
        assert alignment.align_texts(df.limit(0), *paths).count() == 0


def test_texts_are_read_and_aligned_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(i, f"some words of text {i}") for i in range(60)], "doc_id long, text string")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    assert len(alignment.align_texts(df.mapInArrow(counted, df.schema), *paths).collect()) == 60
    assert read.value == 60
