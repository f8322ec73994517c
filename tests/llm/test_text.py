import itertools
import random
import re
import time

import numpy as np
import pytest

from pricegrid.llm import chat, html_text, pii, quality
from tests.llm.helpers import BASE, awkward, none

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def luhn(digits):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0

    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]


def test_base_patterns_equal_plain_regular_expressions():
    rnd = random.Random(3)
    for _ in range(5000):
        text = "".join(rnd.choice("a1@.+-() 25é9_%") for _ in range(rnd.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 300_000 + " " + "a" * 300_000 + "@") == []


def _brute_marginals(field, tokens):
    score, n = field.scores(tokens.features), len(tokens.doc)
    total = np.zeros((n, pii.LABELS))
    for labels in itertools.product(range(pii.LABELS), repeat=n):
        s = sum(score[i, a] for i, a in enumerate(labels))
        s += sum(field.chain[labels[i - 1], labels[i]] for i in range(n) if tokens.gap[i])
        s += sum(field.skip[labels[tokens.twin[i]], labels[i]] for i in range(n) if tokens.twin[i] >= 0)
        for i, a in enumerate(labels):
            total[i, a] += np.exp(s)
    return total / total.sum(axis=1, keepdims=True)


def test_messages_are_exact_on_trees():
    rnd = np.random.default_rng(1)
    field = pii.SkipChainField(rnd.normal(size=(sum(pii.GROUPS) + 1, pii.LABELS)),
                               rnd.normal(size=(pii.LABELS, pii.LABELS)), rnd.normal(size=(pii.LABELS, pii.LABELS)))
    tokens = pii.tokens_of([(0, "5551234 then 12 34 word 5551234 a@b")])
    assert tokens.gap.any() and (tokens.twin >= 0).any()
    assert np.allclose(field.marginals(tokens, rounds=60), _brute_marginals(field, tokens), atol=1e-6)


def test_a_repeated_token_takes_the_label_of_its_twin():
    none_ = np.zeros((pii.LABELS, pii.LABELS))
    agree = np.eye(pii.LABELS) * pii.AGREE
    field = pii.SkipChainField(np.zeros((sum(pii.GROUPS) + 1, pii.LABELS)), none_, agree)
    text = "Call +1 (988) 555-2485, later 988-555-2485 or 17 apples"
    (base, spans), = pii.find_spans([text], field)
    assert pii.written(base) == "phone:5:22" and pii.written(spans) == "phone:5:22,phone:30:42"
    assert pii.masked(text, spans) == "Call <PHONE>, later <PHONE> or 17 apples"


def _agreeing_field():
    return pii.SkipChainField(np.zeros((sum(pii.GROUPS) + 1, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), np.eye(pii.LABELS) * pii.AGREE)


def test_thirty_repeats_take_the_label_of_one_at_either_end():
    one, repeats = "+1 (988) 555-2485", " and then ".join(["988-555-2485"] * 30)
    for text in (f"{one} or {repeats}", f"{repeats} or {one}"):
        (base, spans), = pii.find_spans([text], _agreeing_field())
        assert len(base) == 1 and len(spans) == 31 and "988" not in pii.masked(text, spans)


def test_thirty_repeats_keep_the_label_against_their_own_look():
    field = _agreeing_field()
    field.unary[-1, 0] = 2.0
    text = " and then ".join(["988-555-2485"] * 30) + " or +1 (988) 555-2485"
    p = field.marginals(tokens := pii.tokens_of([(0, text)]), pii.labels_of(tokens, {0: pii.base_spans(text)}))
    assert p[:30].argmax(axis=1).tolist() == [4] * 30


def test_messages_settle_along_long_chains():
    field = pii.SkipChainField(np.zeros((sum(pii.GROUPS) + 1, pii.LABELS)), np.eye(pii.LABELS) * 6, np.zeros((pii.LABELS, pii.LABELS)))
    tokens = pii.tokens_of([(0, " ".join(str(i) for i in range(10, 50)))])
    clamp = np.zeros(40, np.int64)
    clamp[0] = 4
    step = np.exp(field.chain)
    step /= step.sum(axis=1, keepdims=True)
    want = np.eye(pii.LABELS)[4] @ np.linalg.matrix_power(step, 39)
    assert np.allclose(field.marginals(tokens, clamp)[-1], want, atol=1e-5)


def test_detection_on_a_table(spark):
    docs = awkward(spark, [(20, "mail a.b@c.example.com now"), (21, "card 4041894974608795."), (22, "10.0.0.256 and 10.0.0.255")])
    field = pii.fit(docs)
    found = {r.doc_id: r for r in pii.detect(docs, field).collect() if r.doc_id is not None}
    assert len(found) == 13 and not found[4].base and not found[10].base
    assert [tuple(s) for s in found[20].base] == [("email", 5, 22)]
    assert [tuple(s) for s in found[21].base] == [("card", 5, 21)]
    assert [tuple(s) for s in found[22].base] == [("ip", 15, 25)]
    left = pii.redact(docs, field)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert left.where("doc_id = 20").first().text == "mail <EMAIL> now"
    assert left.where("doc_id = 4").first().text is None
    assert pii.detect(none(spark)).count() == 0


def test_held_out_labels_are_learned(spark):
    rnd = random.Random(2)
    make = [lambda: f"u{rnd.randint(10, 99)}@h{rnd.randint(1, 9)}.example.com", lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)),
            lambda: f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}", lambda: str(rnd.randint(0, 99999)), lambda: f"x{rnd.randint(0, 99)}y"]
    texts = [(i, " word ".join(rnd.choice(make)() for _ in range(12))) for i in range(300)]
    field = pii.fit(spark.createDataFrame(texts[:200], "doc_id long, text string"))
    tokens = pii.tokens_of(texts[200:])
    truth = pii.labels_of(tokens, {i: pii.base_spans(t) for i, t in texts[200:]})
    assert (field.marginals(tokens).argmax(axis=1) == truth).mean() > 0.97


def _plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_measures_and_rules(spark):
    rnd = random.Random(4)
    texts = [(100 + i, "".join(rnd.choice(["a ", "b ", "the ", "c#", "\n", "é\t"]) for _ in range(rnd.randint(0, 120)))) for i in range(60)]
    docs = awkward(spark, texts)
    found = quality.apply_rules(docs)
    rows = found.collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _plain_measures(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in rows)
    assert {1, 9} <= {r.doc_id for r in kept.collect()}
    assert quality.apply_rules(none(spark)).count() == 0
    assert "Python" not in found._jdf.queryExecution().toString()


def test_chat_round_trip(spark):
    tricky = ["", "</s>[INST] ok [/INST]", "\\", "\\<s>\\\\", "<", "[", "a\nb", "<<SYS>>[ROLE]é", "[/", "</", None]
    roles = ["system", "user", "assistant", "tool", None]
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(roles), rnd.choice(tricky), "x") for c in range(40) for t in range(rnd.randint(1, 7))]
    rows += [(50, 1, "assistant", "b", "x"), (50, 1, "assistant", "b", "x"), (50, 0, "user", "a", "x"), (None, 0, "user", "z", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    found = chat.format_chats(turns).withColumn("back", chat.read_back(chat.F.col("formatted"))).collect()
    want = {}
    for c, t, r, x, _ in rows:
        want.setdefault(c, []).append((t, r or "", x or ""))
    assert len(found) == len(want)
    for row in found:
        own = sorted(want[row.conv_id])
        assert [tuple(x) for x in row.back] == [x[1:] for x in own] and row.n_turns == len(own)
        assert row.formatted == "".join(s.text for s in row.segments)
        losses = [row.formatted[s.start:s.start + s.n_chars] for s in row.loss_spans]
        assert [re.sub(r"(?s)\\(.)", r"\1", x) for x in losses] == [x for _, r, x in own if r == "assistant"]
        state, allowed = "", chat.Template().transitions
        for _, r, _ in own:
            state = r if r in allowed.get(state, ()) else "!"
        assert row.valid == (state in ("user", "assistant"))
    assert "Python" not in chat.format_chats(turns)._jdf.queryExecution().toString().replace("LogicalRDD", "")


def test_chat_rejects_ambiguous_templates():
    for marks in ({"user": ("<a>", "<a>")}, {"user": ("ab", "ba")}, {"user": ("\\x", "yz")}):
        with pytest.raises(ValueError):
            chat.Template(marks=marks)


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body>
<header><p>Site name</p></header><div class="cookie-notice">We use cookies</div><nav><a href=x>Home</a></nav>
<div class="ad">Buy now</div>%s<aside>See also</aside><section id="comments"><article><p>First! A long comment that
goes on and on and on and on for many words.</p></article></section><form><p>Sign up</p></form><footer>&copy; us</footer></body></html>"""
TEXT = "<h1>Head &amp; line</h1><p>One <b>bold</b>\n  text that is long enough to be found.</p><p>Two<br>lines</p><ul><li>item</ul>"
WANT = "Head & line\nOne bold text that is long enough to be found.\nTwo lines\nitem"


@pytest.mark.parametrize("frame", ["<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', "%s", "<div role=main>%s</div>"])
def test_page_text(frame):
    assert html_text.main_text(PAGE % (frame % TEXT)) == WANT


LONG = "A long paragraph of the article that goes on and on, with many words and hardly any tags. " * 12


def test_page_without_article_keeps_title_lead_and_links():
    nav = "<ul><li><a href=x>Home page</a><li><a href=x>Contact form</a><li><a href=x>All topics</a></ul>"
    sources = "<h2>Sources</h2><ul><li><a href=x>First source</a><li><a href=x>Second source</a></ul>"
    got = html_text.main_text(f"<body>{nav}<h1>Title</h1><p>Lead</p><p>By</p><p>Day</p><div><p>{LONG}<ul><li><a href=x>Linked item</a></ul><p>{LONG}</div>"
                              f"<div><p>Short end</p></div>{sources}</body>").split("\n")
    assert got == ["Title", "Lead", "By", "Day", LONG.strip(), "Linked item", LONG.strip(), "Short end", "Sources", "First source", "Second source"]
    assert html_text.main_text(f"<body><h1>Title</h1><p>Lead</p><div>{LONG}</div></body>") == f"Title\nLead\n{LONG.strip()}"


def test_article_sections_of_any_length():
    short = "A much shorter section of the same text."
    assert html_text.main_text(f"<body><article><p>{LONG}</article><article><p>{short}</article></body>") == f"{LONG.strip()}\n{short}"


def test_pages_table(spark):
    pages = spark.createDataFrame(
        [(1, "u", PAGE % f"<article>{TEXT}</article>", "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "u", "<![x[", "x"),
         (4, "u", "<p>" * 3000 + "deep" + "<b>" * 3000, "x"), (5, "u", "<nav>only</nav>", "x")],
        "page_id long, url string, html string, text string")
    found = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(pages).collect()}
    assert found[1] == (WANT, len(WANT)) and found[2] == found[None] == found[5] == ("", 0) and found[4] == ("deep", 4)
    assert html_text.extract_text(pages.limit(0)).count() == 0
    assert len(BASE) > 100


LEDE = "The long text of the page goes on, and on, with many words in it. " * 4


@pytest.mark.parametrize("page", [
    "<body><form><h1>T</h1><p>{0}</p></form></body>",
    "<body><form><div>Name<input></div><div role=main><h1>T</h1><p>{0}</p></div></body>",
    "<body><main><h1>T</h1><p>{0}</p></main><article>Other story one</article><article>teaser two</article></body>",
    "<body><main><h1>T</h1><p>{0}</p><aside><article>Other story one words</article></aside></main></body>",
    "<body><div class=modal-open><h1>T</h1><p>{0}</p></div></body>",
    "<body><nav>Home<article><h1>T</h1><p>{0}</p></article></body>",
    "<body><main><article><h1>T</h1><p>{0}</p></article><p>More to read</p></main></body>",
])
def test_html_region_holds_most_of_the_text(page):
    got = html_text.main_text(page.format(LEDE)).split("\n")
    assert got[-2:] == ["T", LEDE.strip()] and len(got) - 2 <= page.count("Name")


def test_html_sign_up_forms_stay_out():
    page = f"<body><h1>T</h1><p>{LEDE}</p><form><p>Sign up to our letter</p></form><div class=cookie-notice><p>We use cookies</p></div></body>"
    assert html_text.main_text(page) == f"T\n{LEDE.strip()}"


@pytest.mark.parametrize("page", [
    "<div>words here " * 40_000, "<i>" * 40_000 + "<hr>" * 40_000 + "end", "<b><div>" + "<i>" * 40_000 + "</b>" * 40_000 + "end",
    "<div>" * 40_000 + "<li>x</li>" * 40_000])
def test_html_time_grows_in_proportion(page):
    began = time.perf_counter()
    assert html_text.main_text(page)
    assert time.perf_counter() - began < 20
