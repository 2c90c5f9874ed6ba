from bizlens.llm import quotes
from bizlens.llm.common import table
from bizlens.llm.registry import op7_quotes
from tests.llm.conftest import FOLDER

DDL = "conv_id long, turn long, role string, text string, thread string, p int"


def linked(make, spark, messages):
    from bizlens.llm.common import ship

    ship(spark)
    return quotes.link_quotes(make([(c, t, "user", x, "clash", 1) for c, t, x in messages], DDL)).collect()


def test_parse_levels():
    own, units, quoted = quotes.parse("Hi\n> one  Two\n> three\n>> deep\n> > deeper\n\nBye\n>\n> last")
    assert own == "Hi\n\nBye" and quoted == 6
    assert (1, "one two three") in units and (1, "three") in units and (2, "deep deeper") in units and (0, "hi") in units and (0, "bye") in units and (1, "last") in units


def test_replies_threads_and_order(make, spark):
    rows = linked(make, spark, [
        (1, 0, "The seed arrived late.\nWho pays?"), (1, 1, "Another topic altogether."), (1, 2, "> Who pays?\nThe carrier."),
        (1, 3, "> Another topic\n> altogether.\nYes, please."), (1, 4, ">> Who pays?\n> The carrier.\nAgreed."), (1, 5, "> nobody said this\nHm."),
        (2, 0, "> Who pays?\nSame line, other conversation."), (2, 1, "The carrier."), (2, 2, "The carrier."), (2, 3, ">  the CARRIER.\nnearest wins")])
    got = {(r.conv_id, r.turn): r for r in rows}
    assert {k: r.reply_to for k, r in got.items() if r.reply_to is not None} == {(1, 2): 0, (1, 3): 1, (1, 4): 2, (2, 3): 2}
    assert got[1, 4].depth == 2 and got[1, 4].thread == 0 and got[1, 4].text == "Agreed." and got[1, 4].n_quoted == 2
    assert [t for _, t in sorted((r.position, r.turn) for r in rows if r.conv_id == 1)] == [0, 2, 4, 1, 3, 5]


def test_deeper_levels(make, spark):
    rows = linked(make, spark, [
        (1, 0, "The seed arrived late."), (1, 1, "Another topic altogether."), (1, 2, ">> The seed arrived late.\nOnly the second level."),
        (1, 3, "> an edited line\n>>> Another topic altogether.\nThird level."), (1, 4, "> Third level.\n>> The seed arrived late.\nBoth."),
        (1, 5, "> The seed arrived late.\n>> The seed arrived late.\nTwice."), (1, 6, ">> Itself.\nItself."), (1, 7, ">> Itself.\n> Itself.\nItself.")])
    got = {r.turn: (r.reply_to, r.thread, r.depth, [tuple(s) for s in r.sources or []]) for r in rows}
    assert got == {0: (None, 0, 0, []), 1: (None, 1, 0, []), 2: (0, 0, 1, [(2, 0)]), 3: (1, 1, 1, [(3, 1)]), 4: (3, 1, 2, [(1, 3), (2, 0)]),
                   5: (0, 0, 1, [(1, 0), (2, 0)]), 6: (None, 6, 0, []), 7: (6, 6, 1, [(1, 6), (2, 6)])}


def test_long_chain(make, spark):
    messages = [(1, 0, "line 0")] + [(1, k, f"> line {k - 1}\nline {k}") for k in range(1, 40)]
    got = {r.turn: (r.thread, r.depth, r.position) for r in linked(make, spark, messages)}
    assert got == {k: (0, k, k + 1) for k in range(40)}


def test_odd_rows(make, spark):
    rows = linked(make, spark, [(None, 0, "a"), (None, 1, "> a\nb"), (1, None, "> a"), (1, 0, None), (1, 1, ""), (1, 2, "x"), (1, 2, "x"), (1, 3, ">>>\n> > >"), (1, 4, ">" * 5000)])
    assert len(rows) == 9
    assert sorted(r.position for r in rows if r.conv_id == 1) == list(range(1, 8))
    assert [r.reply_to for r in rows if r.conv_id is None and r.turn == 1] == [0]
    assert quotes.link_quotes(make([], DDL)).count() == 0


def test_query_keeps_every_message(spark):
    source = table(spark, FOLDER, "conversations")
    got = op7_quotes(spark, FOLDER)
    assert got.count() == source.count()
    quoting = source.filter("text rlike '(?m)^[ \\\\t]*>'").count()
    assert got.filter("n_quoted > 0").count() == quoting
