"""Scalar expressions against values worked out by hand, properties, and values written from known facts."""

import datetime as dt
import hashlib
import ipaddress
import random
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from pressroom.functions import dates, replies, text, urls, webhooks
from pressroom.functions.fold import ascii_fold


def column(spark, values, *exprs, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, " + schema)
    rows = df.select("i", *[e.alias(f"c{n}") for n, e in enumerate(exprs)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(exprs) > 1 else r[1] for r in rows]


def added(spark, values, step):
    """Values of the columns that ``step(df)`` appends to (i, v)."""
    df = step(spark.createDataFrame(list(enumerate(values)), "i long, v string"))
    rows = [tuple(r)[2:] for r in df.orderBy("i").collect()]
    return [r[0] if len(r) == 1 else r for r in rows]


def parse(df):
    return df.withColumn("stamp", dates.parse_date(F.col("v")))


def all_characters():
    return [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]


def test_ascii_fold_on_every_character(spark):
    chars = all_characters()
    lines = ["".join(chars[i:i + 97]) for i in range(0, len(chars), 97)]
    want = [unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode() for s in lines]
    assert column(spark, lines, ascii_fold(F.col("v"))) == want


@pytest.mark.parametrize("title,slug", [
    ("Rail strike ends: 40,000 back at work", "rail-strike-ends-40000-back-at-work"),
    ("\t Storm   Nora\n hits  coast ", "storm-nora-hits-coast"),
    ("Who's who? (2nd ed.) -- review", "whos-who-2nd-ed-review"),
    ("Baker’s dozen", "bakers-dozen"),
    ("Ĳs ﬁn – ½ déjà\x1cvu -- ", "ijs-fin-12-deja-vu"),
    ("新闻", ""), ("", ""), (None, ""),
])
def test_slug(spark, title, slug):
    assert column(spark, [title], text.title_slug(F.col("v"))) == [slug]


def test_publisher_and_key(spark):
    names = ["\tNorth  Post ", None, "", "   ", "新聞", "Le  Monde\t"]
    got = column(spark, names, text.publisher_norm(F.col("v")))
    assert got == ["north post", "unknown", "unknown", "unknown", "unknown", "le monde"]
    key = column(spark, ["A  b!"], text.composite_key(F.col("v"), F.lit("X")))[0]
    assert key == hashlib.sha256(b"a-b|x").hexdigest()
    fallback = text.composite_key(F.col("v"), F.lit("X"), F.lit("h"), "url")
    assert column(spark, ["新闻"], fallback)[0] == hashlib.sha256(b"url:h|x").hexdigest()


# URL, canonical form: worked out by hand from the rule (scheme and host in lower case, no credentials, port 0, fragment,
# utm_ parameters, empty parameters or slashes at the end; no form for a bad port or host).
URLS = [
    ("https://u:p@H.com:443//a//?b=&UTM_x=1&&c#f", "https://h.com:443//a?b=&c"), ("HTTP://A.com", "http://a.com/"), ("https://h:0/a", "https://h/a"),
    ("https://h/a;p?q?r", "https://h/a;p?q?r"), ("https://[::1]:80/x", "https://::1:80/x"), ("example.com/a", "example.com/a"), ("mailto:x@y", "mailto:x@y"),
    ("https:///no-host", "https:///no-host"), ("", ""), (None, ""), ("  https://A/b/  ", "https://a/b"), ("https://h:99999/", None), ("https://h:65535/", "https://h:65535/"),
    ("https://h:65536/", None), ("https://h:0443/a", "https://h:443/a"), ("https://h:ab/", None), ("https://[::1/x", None), ("https://h?x#y?z", "https://h/?x"),
    ("https://h#f", "https://h/"), ("https://h/#a/?utm_a=1", "https://h/"), ("https://a@b@C:1/", "https://c:1/"), ("https://h/?utm_source=a&UTM_b=c", "https://h/"),
    ("https://h/a?&&", "https://h/a"), ("https://h:/a", "https://h/a"), ("/a/b/", "/a/b"), ("https://bücher.DE/Ä", "https://bücher.de/Ä"), ("https://ex℀mple.com/", None),
    ("https://h/a%20b?x=%41", "https://h/a%20b?x=%41"), ("\x01\x02https://h/a\tb\nc", "https://h/abc"),
]


def canonical(spark, values):
    return [c for c, _ in added(spark, values, lambda df: urls.with_canonical_url(df, "v", "c", "h"))]


def test_url_canonical_cases(spark):
    got = added(spark, [u for u, _ in URLS], lambda df: urls.with_canonical_url(df, "v", "c", "h"))
    for (url, want), (form, digest) in zip(URLS, got):
        assert form == want, url
        if want:
            assert digest == hashlib.sha256(want.encode()).hexdigest()


def test_url_canonical_properties(spark):
    """On random URLs: twice is once; fragment, utm_ parameters, credentials, host case and slashes at the end change nothing."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcXYZ019-._~%éß", k=rng.randint(1, 6))).replace("%", "%2F")
    rows = []
    for _ in range(800):
        host = ".".join("".join(rng.choices("abcdefgh019", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 3)))
        port = rng.choice(["", "", f":{rng.randint(1, 65535)}"])
        path = "".join("/" + word() for _ in range(rng.randint(0, 3)))
        query = [f"{word()}={word()}" for _ in range(rng.randint(0, 3))]
        plain = f"https://{host}{port}{path or '/'}" + ("?" + "&".join(query) if query else "")
        noisy_query = list(query)
        for extra in rng.choices(["utm_source=a", "UTM_Medium=b", "", "utm_"], k=2):
            noisy_query.insert(rng.randint(0, len(noisy_query)), extra)
        noisy = f"{rng.choice(['https', 'HTTPS'])}://{rng.choice(['', 'me:pw@'])}{host.upper()}{port}{path}{rng.choice(['', '/', '//'])}?{'&'.join(noisy_query)}{rng.choice(['', '#top', '#a?b=c'])}"
        rows.append((plain, noisy))
    assert canonical(spark, [p for p, _ in rows]) == [p for p, _ in rows]
    assert canonical(spark, [n for _, n in rows]) == [p for p, _ in rows]


D = dt.datetime
# Date text, moment: by hand. An offset is dropped, not applied; what no form fits has no moment.
DATES = [
    ("Tue, 03 Mar 2026 08:15:00 GMT", D(2026, 3, 3, 8, 15)), ("Fri, 03 Mar 2026 08:15:00 GMT", D(2026, 3, 3, 8, 15)), ("Wed, 4 Mar 2026 9:3:4 UTC", D(2026, 3, 4, 9, 3, 4)),
    ("mon, 1 DEC 0999 0:0:0 gmt", D(999, 12, 1)), ("2026-03-03T08:15:00+0500", D(2026, 3, 3, 8, 15)), ("2026-03-03T08:15:00+05:30", D(2026, 3, 3, 8, 15)), ("2026-03-03T08:15:00Z", D(2026, 3, 3, 8, 15)),
    ("2026-03-03 08:15:00", D(2026, 3, 3, 8, 15)), ("2026-03-03", D(2026, 3, 3)), ("2026-3-1", D(2026, 3, 1)), ("2024-02-29", D(2024, 2, 29)), ("9999-12-31", D(9999, 12, 31)), ("2026-1-31T0:0:0Z", D(2026, 1, 31)),
    ("Tue, 03 Mar 2026 08:15:00 EST", None), ("Tue, 03 Mar 2026 08:15:00 +0000", None), ("2026-03-03T08:15:00.123Z", None), ("2026-03-03T08:15:00", None), ("Tue, 31 Apr 2026 08:15:00 GMT", None),
    ("2023-02-29", None), ("2026-13-01", None), (" 2026-03-03", None), ("03/03/2026", None), ("", None), (None, None), ("Tuesday, 03 Mar 2026 08:15:00 GMT", None), ("2026-03-03 24:00:00", None),
    ("2026-03-03 08:60:00", None), ("0000-01-01", None), ("2026-03-03T08:15:00+2400", None), ("2026-00-10", None), ("2026-01-00", None),
]


def test_date_cases(spark):
    for (value, want), got in zip(DATES, added(spark, [v for v, _ in DATES], parse)):
        assert got == want, value


def test_dates_written_from_known_moments(spark):
    rng = random.Random(9)
    days, months = "Mon Tue Wed Thu Fri Sat Sun".split(), "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    rows = []
    for _ in range(2500):
        t = D(rng.randint(1, 9999), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59))
        date, clock = f"{t.year:04d}-{t.month:02d}-{t.day:02d}", f"{t.hour:02d}:{t.minute:02d}:{t.second:02d}"
        mail = f"{rng.choice(days)}, {t.day:02d} {months[t.month - 1]} {t.year:04d} {clock}"
        good = rng.choice([f"{mail} GMT", f"{mail} UTC", f"{date}T{clock}{rng.choice(['+0000', '-0730', '+14:00'])}", f"{date}T{clock}Z", f"{date} {clock}", date])
        want = D(t.year, t.month, t.day) if good == date else t
        rows.append((good, want))
        rows.append((rng.choice([good + " ", "x" + good, good.replace(str(t.year).zfill(4), "", 1), good + "0Z", mail, f"{date}T{clock}"]), None))
    for (value, want), got in zip(rows, added(spark, [v for v, _ in rows], parse)):
        assert got == want, value


def test_recency_and_blend(spark):
    stamps = [None, "2024-02-05", "2024-01-28", "2024-01-31"]
    got = added(spark, stamps, lambda df: parse(df).select(
        "i", "v", dates.recency_score(F.col("stamp"), "2024-01-31 00:00:00")))
    assert got[0] == 0.5 and got[1] == 1.0 and got[3] == 1.0
    assert got[2] == pytest.approx(0.36787944117)
    observed = dates.recency_score(F.lit(None).cast("timestamp_ntz"), "2024-01-31 00:00:00", compat="observed")
    assert column(spark, stamps, observed) == [0.5] * 4
    assert column(spark, ["x"], dates.blend(F.lit(0.5), F.lit(1.0)))[0] == pytest.approx(0.65)
    assert dates.since_day("2024-01-31 00:00:00", 7) == "2024-01-24"
    assert dates.since_day("2024-01-31 00:00:00", None) is None


def test_header_and_text(spark):
    c = F.lit
    assert column(spark, ["x"], text.context_header(c(None), c(""), c(None), c("")))[0] == (
        "[Topic: general | Publisher: unknown publisher | Date: unknown date]")
    full = text.enriched_text(c("AI"), c("Post"), c("d"), c("US"), c("T"), c("S"), c(""))
    assert column(spark, ["x"], full)[0] == "[Topic: AI | Publisher: Post | Date: d | US]\nT\nS"


def test_replies(spark):
    good = '{"overall": "mixed", "score": 0.25, "rationale": "r"}'
    cases = [good, f"```json\n{good}\n```", f"```\n{good}```", f"  {good} ", "nope", '{"overall": ', "[1]", good + " tail", "", None]
    rows = added(spark, cases, lambda df: replies.with_parsed_reply(df, "v", replies.SENTIMENT_REPLY, "r"))
    assert [r and r.score for r in rows] == [0.25] * 4 + [None] * 6
    flags = column(spark, ['{"citations": null}', "{}", "x"], replies.has_field(F.col("v"), "citations"))
    assert flags == [True, False, False]


PUBLIC = ["https://alerts.example.org/in?x=1", "https://private.example.org/a", "https://1.1.1.1/h", "https://[2a00:1450:4001::200e]/h", "https://192.0.0.10/", "https://[::ffff:9.9.9.9]/",
          "https://[2001:20::1]/", "https://[2001:3::1]/", "https://172.32.0.1/", "https://223.255.255.255/"]
REFUSED = {
    "empty": ["", None], "scheme": ["gopher://example.org/x", "data:text/plain,hi"], "no host": ["https:///path"], "https required": ["http://alerts.example.org/in"],
    "malformed": ["https://h:70000/x"], "metadata host": ["https://169.254.169.254/latest", "https://Metadata.Azure.com/x"],
    "blocked address": ["https://127.8.9.1/", "https://10.255.0.1/x", "https://192.168.77.3/", "https://172.31.255.255/", "https://169.254.0.9/", "https://0.1.2.3/", "https://239.0.0.1/", "https://255.255.255.255/",
                        "https://198.19.255.255/", "https://192.0.0.8/", "https://[::]/", "https://[::1]/", "https://[fe80::1%25eth0]/", "https://[fe80::1%eth0]/", "https://[fd12:3456::1]/", "https://[ff02::1]/",
                        "https://[::ffff:10.0.0.1]/", "https://[::ffff:7f00:1]/", "https://[2001:db8:1::2]/", "https://[2001:0:1::]/", "https://[2002:a00:1::]/", "https://[64:ff9b::1]/", "https://[100::1]/", "https://[4000::1]/",
                        "https://[3fff:fff::1]/", "https://[::8.8.8.8]/"],
}


def test_webhooks(spark):
    flat = [(u, why) for why, some in REFUSED.items() for u in some] + [(u, None) for u in PUBLIC]
    got = added(spark, [u for u, _ in flat], lambda df: webhooks.with_webhook_reason(df, "v"))
    for (url, why), reason in zip(flat, got):
        assert reason == why, url
    assert added(spark, ["http://alerts.example.org/in"], lambda df: webhooks.with_webhook_reason(df, "v", allow_http=True)) == [None]


def test_webhook_network_borders(spark):
    """First and last address of each listed IPv4 network are refused, their outer neighbours are judged by the other networks."""
    nets = [ipaddress.ip_network(n) for n in webhooks.BLOCKED_IPV4]
    numbers = sorted({n for net in nets for n in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1) if 0 <= n < 2**32})
    hosts = [str(ipaddress.ip_address(n)) for n in numbers]
    for form in ("https://{}/x", "https://[::ffff:{}]/x"):
        got = added(spark, [form.format(h) for h in hosts], lambda df: webhooks.with_webhook_reason(df, "v"))
        for host, reason in zip(hosts, got):
            assert (reason is not None) == any(ipaddress.ip_address(host) in net for net in nets), host


def test_words_match_the_full_text_index(spark):
    """Every assigned letter and mark, tokenised as the stdlib full-text module does."""
    chars = [c for c in all_characters() if unicodedata.category(c)[0] in "LNM" and ord(c) < 0x2000]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t)")
    db.execute("create virtual table v using fts5vocab(f, 'instance')")
    lines = [f"a{c}b {c} Aé{c}" for c in chars]
    db.executemany("insert into f(rowid, t) values (?, ?)", list(enumerate(lines)))
    want = {}
    for term, doc, _, offset in db.execute("select term, doc, col, offset from v"):
        want.setdefault(doc, {})[offset] = term
    got = column(spark, lines, text.words(F.col("v")))
    wrong = [c for i, c in enumerate(chars) if got[i] != [want[i][k] for k in sorted(want[i])]]
    # The listed exception: letters and digits younger than the index's character tables (it splits words at them), and marks.
    # Of all others, every one agrees.
    blocks = {(0x0370, 0x03FF), (0x0500, 0x052F), (0x0590, 0x08FF), (0x0900, 0x0DFF), (0x0E00, 0x0FFF), (0x1000, 0x10FF), (0x13A0, 0x13FF), (0x1700, 0x1CFF)}
    letters = [c for c in wrong if unicodedata.category(c)[0] != "M"]
    assert all(any(a <= ord(c) <= b for a, b in blocks) for c in letters), [hex(ord(c)) for c in letters]
    assert len(letters) < 0.05 * len(chars)
