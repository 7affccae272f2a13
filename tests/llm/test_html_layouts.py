"""Page extraction where no page says what its article is."""

import re

from threatlake.llm.common import table
from threatlake.llm.html_extract import extract_pages, label, train_on
from threatlake.llm.html_tree import blocks, parse


def test_table_without_articles(spark, sf_dir):
    html = {r.page_id: r.html for r in table(spark, sf_dir, "pages").collect() if re.search("(?i)<(article|main)[ >]", r.html or "")}
    plain = {i: re.sub(r"(?i)<(/?)(article|main)\b", r"<\1section", x) for i, x in html.items()}
    pages = spark.createDataFrame([(i, "u", x) for i, x in plain.items()], "page_id bigint, url string, html string")
    found = {r.page_id: r.text.split("\n") for r in extract_pages(pages, train_on(pages)).collect()}
    hit = wrong = missed = 0
    for i, x in html.items():
        nodes = parse(x)
        truth = label(nodes)
        right = {b.text for b in blocks(nodes) if truth[b.node]}
        hit, wrong, missed = hit + len(right & set(found[i])), wrong + len(set(found[i]) - right - {""}), missed + len(right - set(found[i]))
    print(hit, wrong, missed)
    assert hit >= 0.8 * (hit + missed) and hit >= 0.8 * (hit + wrong)
