from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from ledgerline.llm import quotes
from ledgerline.llm.queries import ORACLE_SQL, QUERIES
from ledgerline.sources.workspace import Workspace

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = (
    "conv_id", "turn", "role", "own_text", "quoted_lines", "deepest_quote",
    "linked_lines", "reply_to", "thread", "depth", "position",
)


def answered(spark, rows, extra=()) -> list:
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *extra)
    return quotes.link_quotes(table, Workspace(spark, "t")).collect()


def plain(line: str) -> str:
    line = re.sub(r"^[ \t]*((?:>[ \t]?)+)", "", line).lower()
    return re.sub(r"[\W_]+", " ", line).strip(" ")


def brute(rows) -> dict:
    """(conversation, turn): reply_to, linked lines, thread, depth; turns are unique here."""
    out, first = {}, {}

    def runs(text):
        """(level, paragraphs of plain lines) of successive lines of one level."""
        found, last = [], None
        for x in (text or "").split("\n"):
            level = (re.match(r"^[ \t]*((?:>[ \t]?)+)", x) or [""])[0].count(">")
            if level != last:
                found.append((level, [[]]))
            last = level
            if plain(x):
                found[-1][1][-1].append(plain(x))
            else:
                found[-1][1].append([])
        return [(level, [p for p in parts if p]) for level, parts in found if any(parts)]

    def passage(*paragraphs):
        return "passage", "".join(x for p in paragraphs for x in p).replace(" ", "")

    ordered = sorted(rows, key=lambda r: r[1])
    for conv, turn, _, text in ordered:
        for level, parts in runs(text):
            keys = [passage(*parts), *(passage(p) for p in parts)]
            keys += [passage(*two) for two in zip(parts, parts[1:], strict=False)]
            keys += [("line", x) for p in parts for x in p]
            for key in [] if level else keys:
                first.setdefault((conv, key), turn)
    for conv, turn, _, text in ordered:
        found = Counter()
        for level, parts in runs(text):
            for p in parts if level else []:
                for x in p:
                    tried = (first.get((conv, key), turn) for key in (passage(*parts), passage(p), ("line", x)))
                    original = next((t for t in tried if t < turn), None)
                    if original is not None:
                        found[level, original] += 1
        best = min(found, key=lambda k: (k[0], -found[k], -k[1]), default=(0, None))[1]
        parent = out.get((conv, best))
        out[conv, turn] = (best, found.total(), parent[2] if parent else turn, parent[3] + 1 if parent else 0)
    return out


@pytest.fixture(scope="module")
def conversations():
    """Random threads in which messages quote each other, nested."""
    random.seed(5)
    rows, vocabulary = [], [f"word{i}" for i in range(300)]
    for conv in range(30):
        texts = []
        for turn in range(random.randint(1, 14)):
            own = [" ".join(random.choices(vocabulary, k=random.randint(1, 6))) for _ in range(random.randint(1, 3))]
            quoted = []
            if texts and random.random() < 0.7:
                source = random.choice(texts)
                quoted = [f"> {x}" for x in source.split("\n") if random.random() < 0.8]
            head = ["On Monday, Ann wrote:"] if quoted and random.random() < 0.5 else []
            texts.append("\n".join([*head, *quoted, random.choice(("\n", "\n\n")).join(own)]))
            rows.append((conv, turn, random.choice(["user", "assistant"]), texts[-1]))
    return rows


def test_against_brute_force(spark, conversations):
    got = answered(spark, conversations)
    expected = brute(conversations)
    assert {(r.conv_id, r.turn): (r.reply_to, r.linked_lines, r.thread, r.depth) for r in got} == expected
    assert sum(r.depth > 2 for r in got) > 3
    by_conversation = defaultdict(list)
    for r in got:
        assert ">" not in r.own_text and "wrote:" not in r.own_text
        by_conversation[r.conv_id].append(r)
    for own in by_conversation.values():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(1, len(own) + 1))
        seen = set()
        for r in own:
            assert r.reply_to is None or r.reply_to in seen
            seen.add(r.turn)


def assert_twin(spark, rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    twin = con.sql(f"SELECT {', '.join(NAMES)} FROM ({ORACLE_SQL['op10_quotes']})").fetchall()
    assert Counter(tuple(r[n] for n in NAMES) for r in answered(spark, rows)) == Counter(twin)


def test_against_sql(spark, conversations):
    assert_twin(spark, conversations)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    twin = con.sql(f"SELECT {', '.join(NAMES)} FROM ({ORACLE_SQL['op10_quotes']})").fetchall()
    got = QUERIES["op10_quotes"](spark, FOLDER)
    assert Counter(tuple(r[n] for n in NAMES) for r in got.collect()) == Counter(twin)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_nested_levels(spark):
    rows = [
        (1, 0, "a", "The first message here."), (1, 1, "b", "> the FIRST message, here!\nA second one follows"),
        (1, 2, "a", ">> The first message here.\n> A second one follows\n\nThird answer here"),
        (1, 3, "b", "> > a second one follows\nnone of the first level is known"),
        (1, 4, "a", "> never written by anyone\nalone"), (2, 5, "a", "> The first message here.\nelsewhere"),
    ]
    got = {(r.conv_id, r.turn): r for r in answered(spark, rows)}
    assert [got[1, t].reply_to for t in range(5)] == [None, 0, 1, 1, None]
    assert [got[1, t].depth for t in range(5)] == [0, 1, 2, 2, 0]
    assert got[1, 2].own_text == "Third answer here" and got[1, 2].deepest_quote == 2
    assert got[2, 5].reply_to is None and got[2, 5].own_text == "elsewhere"


def test_odd_messages(spark):
    long = "\n".join(f"line number {i}" for i in range(20_000))
    rows = [
        (1, 0, "a", None), (1, 1, None, ""), (1, 2, "a", ">\n>>\n>"), (None, 3, "a", "> some words here"),
        (None, None, None, "some words here"), (2, 0, "a", long), (2, 1, "b", long.replace("line", "> line")),
        (3, 0, "a", "words in a row"), (3, 0, "a", "words in a row"), (3, 1, "b", "> words in a row"), (3, 1, "b", "> words in a row"),
    ]
    got = answered(spark, rows, ("1 AS thread", "2 AS message", "'x' AS position", "3 AS hash"))
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.conv_id, r.turn].append(r)
    assert by[1, 0][0].own_text == by[1, 1][0].own_text == by[1, 2][0].own_text == ""
    assert by[2, 1][0].reply_to == 0 and by[2, 1][0].linked_lines == 20_000
    assert [r.reply_to for r in by[3, 1]] == [0, 0] and sorted(r.position for r in by[3, 0] + by[3, 1]) == [1, 2, 3, 4]
    assert by[None, 3][0].reply_to is None
    assert answered(spark, []) == []


def test_a_long_chain_of_replies(spark):
    rows = [(1, t, "a", f"> this is message {t - 1}\nthis is message {t}") for t in range(200)]
    got = answered(spark, rows)
    assert {r.turn: (r.thread, r.depth) for r in got} == {t: (0, t) for t in range(200)}


def test_rewrapped_passages(spark):
    """A passage is found however its lines break, also in a script without blanks."""
    words = "one long sentence that a mail client breaks where it wants to, over several lines"
    rows = [
        (1, 0, "a", words), (1, 1, "b", "> one long sentence that a mail\n> client breaks where it wants to,\n> over several lines\nfirst answer given"),
        (1, 2, "a", "> > One long sentence that a mail client\n> > breaks where it wants to, over several lines\n> first\n> answer given\nthe second answer"),
        (2, 0, "a", "a line of its own\nand another line\nand the third one"), (2, 1, "b", "> a line of its own and\n> another line and the third one\nagreed"),
        (3, 0, "a", "これは折り返される日本語の長い文です"), (3, 1, "b", "> これは折り返される\n> 日本語の長い文です\n返事"),
        (4, 0, "a", "the first line here\nthe second line here"), (4, 1, "b", "> the second line here\npartly quoted"),
    ]
    got = {(r.conv_id, r.turn): r for r in answered(spark, rows)}
    assert {k: (r.reply_to, r.linked_lines, r.depth) for k, r in got.items() if k[1]} == {
        (1, 1): (0, 3, 1), (1, 2): (1, 4, 2), (2, 1): (0, 2, 1), (3, 1): (0, 2, 1), (4, 1): (0, 1, 1),
    }


def test_short_quotes(spark):
    rows = [
        (1, 0, "a", "yes"), (1, 1, "b", "> yes\nok"), (1, 2, "a", "> ok\n42"), (1, 3, "b", "> 42\n好的"), (1, 4, "a", "> 好的\nthanks"),
        (2, 0, "a", "is it so\nok"), (2, 1, "b", "ok"), (2, 2, "a", "> ok\nno"), (2, 3, "b", "> so\nno"), (2, 4, "a", "> is it so\nno"),
    ]
    got = {(r.conv_id, r.turn): (r.reply_to, r.linked_lines) for r in answered(spark, rows)}
    assert [got[1, t] for t in range(1, 5)] == [(0, 1), (1, 1), (2, 1), (3, 1)]
    # As a whole passage "ok" is that of turn 1; a part of a line is no quote of it.
    assert [got[2, t] for t in range(2, 5)] == [(1, 1), (None, 0), (0, 1)]


def test_short_lines_and_breaks_against_brute_force(spark, conversations):
    """The same threads, and such whose quotes break at other places or repeat one-word answers."""
    random.seed(6)
    rows = list(conversations)
    for conv in range(100, 130):
        texts = []
        for turn in range(random.randint(1, 14)):
            own = [random.choice(("yes", "no", "ok ok", " ".join(random.choices("abcdefgh", k=12)))) for _ in range(random.randint(1, 2))]
            quoted = []
            if texts and random.random() < 0.8:
                words, size = random.choice(texts).split(), random.randint(1, 9)
                quoted = ["> " + " ".join(words[i : i + size]) for i in range(0, len(words), size)]
            texts.append("\n".join(own))
            rows.append((conv, turn, "user", "\n".join([*quoted, *own])))
    got = {(r.conv_id, r.turn): (r.reply_to, r.linked_lines, r.thread, r.depth) for r in answered(spark, rows)}
    assert got == brute(rows)
    assert_twin(spark, rows)


def test_paragraphs_are_found_however_they_break(spark):
    one = "one long sentence that a mail client breaks where it wants to"
    two = "and a second paragraph with another sentence, broken elsewhere"
    three = "the third one is left out of most replies that quote the message"
    wrapped = lambda text, size: "\n".join(
        "> " + " ".join(text.split()[i : i + size]) for i in range(0, len(text.split()), size)
    )
    rows = [
        (1, 0, "a", f"{one}\n\n{two}\n\n{three}"),
        (1, 1, "b", f"{wrapped(two, 4)}\nsecond only"),
        (1, 2, "b", f"{wrapped(one, 5)}\n\n{wrapped(two, 3)}\nwith a blank line between them"),
        (1, 3, "b", f"{wrapped(one, 5)}\n>\n{wrapped(two, 3)}\nwith a quoted blank line"),
        (1, 4, "b", f"{wrapped(two + ' ' + three, 6)}\ntwo paragraphs run together"),
        (1, 5, "b", f"{wrapped(one, 5)}\n>\n> never written\npartly known"),
        (2, 6, "b", f"{wrapped(two, 4)}\nanother conversation"),
    ]
    got = {r.turn: r for r in answered(spark, rows)}
    assert [got[t].reply_to for t in range(7)] == [None, 0, 0, 0, 0, 0, None]
    assert [got[t].linked_lines for t in range(1, 6)] == [3, 6, 6, 4, 3]
    assert {(r.conv_id, r.turn): (r.reply_to, r.linked_lines, r.thread, r.depth) for r in got.values()} == brute(rows)
    assert_twin(spark, rows)
