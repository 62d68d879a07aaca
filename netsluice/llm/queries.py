"""Every operator applied to its whole table, with the parameters of production."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers

from netsluice.llm import (
    bag_minhash,
    byte_bpe,
    fill_in_middle,
    hnsw,
    line_join,
    line_quality,
    main_text,
    ngram_trie,
    packing,
    periodic_runs,
    suffix_dedup,
    url_rules,
    warc,
)
from netsluice.llm.catalog import query
from netsluice.llm.common import table


@query("op1_line_join")
def op1(spark, sf_dir):
    return line_join.deduplicated_lines(table(spark, sf_dir, "documents")).drop("text_key")


@query("op2_warc_salvage")
def op2(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


@query("op3_bag_minhash")
def op3(spark, sf_dir):
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


@query("op4_line_quality")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return line_quality.assess(docs, line_quality.train(docs, table(spark, sf_dir, "labels")))


@query("op5_main_text")
def op5(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return main_text.extracted(pages, main_text.train(pages))


@query("op6_best_fit_packing")
def op6(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), added_tokens=True)


@query("op7_hnsw_near_duplicates")
def op7(spark, sf_dir):
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_byte_bpe")
def op8(spark, sf_dir):
    return byte_bpe.round_trip_digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query("op9_suffix_dedup")
def op9(spark, sf_dir):
    return suffix_dedup.digests_without_repeats(table(spark, sf_dir, "documents"), in_place=True)


@query("op10_ngram_trie")
def op10(spark, sf_dir):
    return ngram_trie.score_documents(table(spark, sf_dir, "documents"), order=3, min_count=1)


URL_SQL = r"""
    with urls as (
        select distinct url, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as folded,
            translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1) as path
        from pages where url is not null),
    sites(h, p, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
        ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    patterns(pattern, regex, verdict) as (values
        ('://*^casino^*/', '(?s)://.*([^a-z0-9%]|\z)casino([^a-z0-9%]|\z).*/', 'block'),
        ('://*^pills^*/', '(?s)://.*([^a-z0-9%]|\z)pills([^a-z0-9%]|\z).*/', 'block'),
        ('://*^bets^*/', '(?s)://.*([^a-z0-9%]|\z)bets([^a-z0-9%]|\z).*/', 'block'),
        ('://*^poker^*/', '(?s)://.*([^a-z0-9%]|\z)poker([^a-z0-9%]|\z).*/', 'block'),
        ('^login^', '([^a-z0-9%]|\z)login([^a-z0-9%]|\z)', 'block'),
        ('^cart^', '([^a-z0-9%]|\z)cart([^a-z0-9%]|\z)', 'block'),
        ('/search?', '/search\?', 'block'),
        ('||blog.tionsh.*/en/*?utm_source=feed|',
            '(?s)\A[a-z][a-z0-9+.-]*://([^/?#]*\.)?blog\.tionsh\..*/en/.*\?utm_source=feed\z', 'block'),
        ('^page=2^ref=x|', '([^a-z0-9%]|\z)page=2([^a-z0-9%]|\z)ref=x\z', 'block'),
        ('/\/[0-9]{5,}(\.html|\/)?$/', '/[0-9]{5,}(\.html|/)?$', 'block'),
        ('||m.casino-win.example.org^', '(?s)\A[a-z][a-z0-9+.-]*://([^/?#]*\.)?m\.casino-win\.example\.org([^a-z0-9%]|\z)', 'allow'),
        ('^example.org/de/', '([^a-z0-9%]|\z)example\.org/de/', 'allow')),
    by_site as (
        select url, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict
        from urls join sites on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by url),
    by_pattern as (
        select url, pattern, verdict from urls join patterns on regexp_matches(folded, regex)
        qualify row_number() over (partition by url order by verdict = 'block', length(pattern) desc, pattern) = 1)
    select page_id, coalesce(u.host, '') as host, coalesce(u.path, '') as path, s.rule,
        coalesce(s.verdict, p.verdict, 'allow') as verdict, case when s.rule is null then p.pattern end as pattern
    from pages left join urls u using (url) left join by_site s using (url) left join by_pattern p using (url)
"""


@query("op11_url_rules", URL_SQL)
def op11(spark, sf_dir):
    return url_rules.judged(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, url_rules.SITES, url_rules.PATTERNS))


FIM_SQL = r"""
    with texts as (
        select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
            regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens
        from documents),
    drawn as (
        select doc_id, text, tokens, len(tokens) as n, ('0x' || h[1:8])::bigint % (len(tokens) + 1) as a,
            ('0x' || h[9:16])::bigint % (len(tokens) + 1) as b,
            case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
                or ('0x' || h[17:24])::bigint % 100 >= 50 then 'plain' when ('0x' || h[25:32])::bigint % 100 < 80 then 'spm' else 'psm' end as form
        from texts),
    cut as (
        select *, array_to_string(tokens[1:least(a, b)], '') as prefix, array_to_string(tokens[least(a, b) + 1:greatest(a, b)], '') as middle,
            array_to_string(tokens[greatest(a, b) + 1:], '') as suffix
        from drawn)
    select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
        case when form <> 'plain' then length(middle) end as middle_chars,
        sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
        sha256(text) as restored_sha256
    from cut
"""


@query("op12_fill_in_middle", FIM_SQL)
def op12(spark, sf_dir):
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_cycles(table(spark, sf_dir, "documents"))))


@query("pipeline")
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
