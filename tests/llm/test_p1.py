"""Problem 1: the automaton against brute force, misreadings outside the tables, and entries that come with the pages."""

import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from conftest import SMALL

from ferrule.llm import p1_scans as p1

PAGES = "/root/testdata/sf0.1/parsed_segments.parquet"


def test_automaton_is_complete():
    r = random.Random(1)
    say = lambda: "".join(r.choice("abcdelmnoruvwi") for _ in range(r.randint(1, 9)))
    words = sorted({say() for _ in range(2000)})
    trie = p1.Trie(words)
    for read in [*r.sample(words, 40), *(say() for _ in range(40))]:
        for budget, other in ((2, 2), (4, 2), (2, 9)):
            assert p1.automaton(trie, read, budget, other) == [w for w in words if p1.edit_cost(w, read, other) <= budget]


def test_common_misreadings_are_retrieved():
    vocab = p1.Vocabulary({w: 100 for w in "request vendor house before table record modern the have official policy".split()})
    for read, word in (("raquest", "request"), ("vendar", "vendor"), ("bouse", "house"), ("betore", "before"), ("tabie", "table"), ("tble", "table"), ("recoord", "record"), ("rnodern", "modern"), ("bave", "have"), ("ofticial", "official")):
        assert word in vocab.within(read, 2), read
    assert p1.misread_word("P0LICY", vocab) == "POLICY"


@pytest.fixture(scope="module")
def pages():
    rows = pq.read_table(PAGES, columns=["text", "content_type"]).to_pylist()
    texts = [x["text"] for x in rows if x["content_type"] == "page" and x["text"]]
    counts = Counter()
    for t in texts:
        p1._units(t, counts)
    return texts, p1.Vocabulary({u: n for u, n in counts.items() if n >= p1.MIN_COUNT})


def repaired(text, vocab):
    return p1.repair(text, False, False, None, None, vocab)


def test_edits_outside_the_table(pages):
    """One letter of a known word replaced, left out, put in or swapped at random, not as in the table."""
    texts, vocab = pages
    r = random.Random(2)
    whole = made = false = 0
    for t in r.sample([t for t in texts if not p1.is_han(t)], 300):
        places = [m.span() for m in re.finditer(r"(?<=\s)[a-z]{4,}(?=\s)", t) if vocab.count(m.group()) >= 10]
        if not places:
            continue
        a, b = r.choice(places)
        w, c = t[a:b], r.choice("abdefghjkoprstuvwxyz")
        i = r.randrange(len(w) - 1)
        read = r.choice([w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])
        if vocab.count(read) or p1.edit_cost(w, read) != 2:
            continue
        made += 1
        before, after = repaired(t, vocab), repaired(t[:a] + read + t[b:], vocab)
        whole += after[1] == before[1]
        false += "glyph" in before[0] and after[1] == before[1] and repaired(before[1], vocab)[1] != before[1]
    assert made > 100 and whole / made >= 0.9 and false / made < 0.05


def test_characters_outside_the_table(pages):
    """A Chinese character within known surroundings replaced by any common one."""
    texts, vocab = pages
    r = random.Random(3)
    common = [c for c, _ in Counter("".join(texts)).most_common(1500) if "一" <= c <= "鿿"]
    whole = made = 0
    for t in r.sample([t for t in texts if p1.is_han(t)], 300):
        places = [m.start() for m in re.finditer("(?<=[一-鿿]{3})[一-鿿](?=[一-鿿]{3})", t) if min(vocab.count(t[m.start() - k : m.start() - k + 3]) for k in (0, 1, 2)) >= 20 and t[m.start()] not in p1.HAN_NUMERALS]
        if places:
            i = r.choice(places)
            c = r.choice([c for c in common if c != t[i] and p1.HAN.get(c) != t[i]])
            made += 1
            whole += repaired(t[:i] + c + t[i + 1 :], vocab)[1] == repaired(t, vocab)[1]
    assert made > 200 and whole / made >= 0.87


def test_entries_that_come_with_the_pages(spark):
    """With few entries sent to all executors the results are the same."""
    segments = spark.read.parquet(f"{SMALL}/parsed_segments.parquet")
    rows = lambda most: {r.segment_id: (sorted(r.damage), r.body) for r in p1.page_damage(segments, most).collect()}
    assert rows(10**9) == rows(300)


def test_all_entries_come_with_damaged_pages(spark):
    """With two free edits in long words, misreadings and digits in others, and any characters in Chinese, too."""
    r = random.Random(5)

    def damaged(t):
        def word(m):
            w = m.group()
            if r.random() < 0.7:
                return w
            if len(w) >= 8:
                for _ in range(2):
                    i = r.randrange(len(w) - 1)
                    w = r.choice([w[:i] + r.choice("abdghkpstx") + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])
                return w
            return w.replace("e", "c").replace("l", "1").replace("o", "0").replace("m", "rn")

        t = re.sub("[a-z]{4,}", word, t)
        return re.sub("[一-鿿]", lambda m: r.choice("的报销冋淸宙夭甴囗") if r.random() < 0.03 else m.group(), t)

    rows = spark.read.parquet(f"{SMALL}/parsed_segments.parquet").filter("content_type = 'page'").select("segment_id", "document_id", "seq", "text", "content_type").collect()
    rows = [(x.segment_id, x.document_id, x.seq, damaged(x.text) if x.text and k % 2 else x.text, x.content_type) for k, x in enumerate(rows)]
    segments = spark.createDataFrame(rows, "segment_id long, document_id string, seq int, text string, content_type string")
    got = lambda most: {x.segment_id: (sorted(x.damage), x.body) for x in p1.page_damage(segments, most).collect()}
    assert got(10**9) == got(100)


def test_keys_meet():
    """Whatever the automaton may find has a key in common with what was read."""
    r = random.Random(6)
    say = lambda n: "".join(r.choice("abcdelmnoruvwi") for _ in range(n))
    swaps = [(m, read) for read, ms in p1.LATIN.items() for m in ms]
    for _ in range(4000):
        word = read = say(r.randint(3, 12))
        for _ in range(r.randint(1, 4)):
            i = r.randrange(len(read) + 1)
            m, x = r.choice(swaps)
            read = r.choice([read.replace(m, x, 1), read[:i] + say(1) + read[i + 1 :], read[:i] + read[i + 1 :], read[:i] + say(1) + read[i:], read[:i] + read[i : i + 2][::-1] + read[i + 2 :]])
        budget = 4 if len(read) >= p1.LONG_WORD else 2
        if read and p1.edit_cost(word, read) <= budget:
            assert p1.deletions(word.lower(), len(word) >= p1.LONG_WORD - 2) & p1.deletions(read.lower(), len(read) >= p1.LONG_WORD)


def test_long_titles_and_marked_numbers():
    assert p1.may_be_title("A very long running title of a manual that nobody would ever print " * 2)
    assert p1.page_numbers(["a", "b", "- 12 -", "c", "d", "12", "e", "f"]) == {2}
