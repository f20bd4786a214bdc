"""Inputs made to break the corpus operators: drifting offsets, broken and deep pages,
colliding words, odd record ids."""
import time

import pytest

from mktlens.llm import automata, decontamination, html, iblt, warc

TEXT = "The first paragraph of the article. " * 5


def test_letters_that_change_length_in_lower_case():
    page = f"<html><body><div class='x'>{'İ' * 60}<script>var a = '<p>';</SCRIPT><p>{TEXT}</p><p>{TEXT}</p></div></body></html>"
    assert html.extract(page, None) == "\n".join(["İ" * 60, TEXT.strip(), TEXT.strip()])


@pytest.mark.parametrize("page", ['<a "' * 100_000, '<a "' * 99_999 + ">", "<div>" * 100_000 + "text", "<div><p>t" * 30_000, "<div>" * 50_000 + "</span>" * 50_000 + "x",
                                  "<svg>" * 50_000 + "x", "<b><i>" * 30_000 + "x", "<header>" * 20_000 + "<p>y" * 20_000, "<!--" * 100_000, "<li><div>" * 20_000 + "z"])
def test_broken_and_deep_pages_take_linear_time(page):
    began = time.process_time()
    html.extract(page, ">div>div")
    assert time.process_time() - began < 4


def test_deep_path_is_found_again():
    page = "<html><body>" + "<div class='a1'>" * 300 + f"<p>{TEXT}</p>" + "</div>" * 300 + "</body></html>"
    elements, pieces = html.parse(page)
    html.measure(elements, pieces)
    path = html.best(elements).path()
    assert path.startswith(">div.a#>div.a#") and html.digest_of(path) == html.best(elements).chain.digest()
    assert html.extract(page, path) == TEXT.strip()


def thue_morse(n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_that_collide_in_polynomial_sums_are_apart(spark, size):
    a, b = thue_morse(size)
    docs = spark.createDataFrame([(1, a), (2, f"x {b} y")], "doc_id long, text string")
    items = spark.createDataFrame([(7, b)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.contaminated) for r in decontamination.contamination(docs, items).collect()}
    assert got == {1: (0, False), 2: (1, True)}
    near = {r.doc_id: r.near_next for r in iblt.fingerprints(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()}
    assert near[1] < 1.0
    copies = spark.createDataFrame([(1, " ".join([a] * 13)), (2, " ".join([b] * 13))], "doc_id long, text string")
    assert {r.n_removed for r in automata.remove_repeats(copies).collect()} == {0}


def test_record_ids_come_back_as_they_were(spark):
    ids = ["a>", "", "<", ">", "<a>", "  ", "%41", "urn:page:x", "line\nbreak", None, "é", "urn:page-without-id:"]
    pages = spark.createDataFrame([(x, "u", "same" if i % 2 else f"own {i}") for i, x in enumerate(ids)], "page_id string, url string, html string")
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert sorted((r.record_id for r in got), key=repr) == sorted(ids, key=repr)
    top = max(x for i, x in enumerate(ids) if i % 2 and x is not None)
    same = {r.record_id: r.refers_to for r in got if r.payload_bytes == 4}
    assert same == {x: None if x == top else top for i, x in enumerate(ids) if i % 2}
