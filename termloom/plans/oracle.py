"""SQL that says the same as the queries, for a second engine."""

from __future__ import annotations

from termloom.operators.supervised import MORPHEMES

WORD = r"[\p{L}\p{N}_]+"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"

FORCE = """
    t as (select doc_id, text, words from processed_corpus where doc_id is not null
          qualify row_number() over (partition by doc_id order by revised_at desc nulls last) = 1)"""
NDOCS = "n as (select count(*)::double as n_docs from t)"
TOKENS = rf"tok as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') as w from t)"
SPANS = """
    sp as (select doc_id, text, list_filter(words, lambda x: x is not null) as s from t where text is not null and words is not null),
    tok as (select doc_id, s, list_transform(s, lambda x: substring(text, greatest(x."start", 0) + 1, greatest(x."end" - greatest(x."start", 0), 0))) as w from sp),
    n as (select count(*)::double as n_docs from sp)"""
GRAMS = """
    cand as (select doc_id, (len(w) + greatest(len(w) - 1, 0))::bigint as n_ngrams,
                    unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from tok),
    counts as (select doc_id, n_ngrams, term, count(*) as cnt from cand group by all),
    stat as (select term, count(*) as df, sum(cnt)::bigint as cf from counts group by term)"""
REFERENCE = rf"""
    r as (select distinct doc_id, text from reference_corpus),
    rtok as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') as w from r),
    rcand as (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from rtok),
    rcounts as (select doc_id, term, count(*) as cnt from rcand group by all),
    rstat as (select term, count(*) as ref_df, sum(cnt) as ref_cf from rcounts group by term),
    rn as (select count(*)::double as ref_docs from r),
    rall as (select sum(cnt) as ref_all from rcounts)"""
BASE = f"with {FORCE}, {NDOCS}, {TOKENS}, {GRAMS}"
SPAN_BASE = f"with {FORCE}, {SPANS}, {GRAMS}"
NESTING = """
    starts as (select doc_id, term, cnt, unnest(range(1, len(term) + 1)) as i from counts where len(term) between 1 and 60),
    parts as (select doc_id, term as container, cnt as other, substring(term, i, unnest(range(1, len(term) - i + 2))) as term from starts),
    near as (select distinct parts.doc_id, parts.term, container, other from parts join counts on counts.doc_id = parts.doc_id and counts.term = parts.term where parts.term <> container
             union all
             select a.doc_id, a.term, b.term, b.cnt from counts b join counts a on a.doc_id = b.doc_id and a.term <> b.term and contains(b.term, a.term) where len(b.term) > 60 and a.term <> ''),
    outer_ as (select doc_id, term, count(*) as n_containing, sum(other)::bigint as cnt_containing from near group by all),
    inner_ as (select doc_id, container as term, count(*) as n_contained from near group by all),
    nest as (select doc_id, term, cnt, coalesce(n_containing, 0)::bigint as n_containing, coalesce(cnt_containing, 0)::bigint as cnt_containing, coalesce(n_contained, 0)::bigint as n_contained,
                    len(list_filter(string_split_regex(term, '\\s+'), lambda x: x <> '')) as k
             from counts left join outer_ using (doc_id, term) left join inner_ using (doc_id, term) where term <> '')"""
IDF = "ln(n_docs / (1 + df))"
RIDF = "ln(df / (1 + n_docs * (1 - exp(-cf))))"
TOP200 = f"""
    basics as (select doc_id, term, k * ln(cnt + 1) + 0.5 * n_containing as s from nest),
    top as (select * from basics order by round(s, 9) desc, doc_id, term limit 200),
    terms_ as (select distinct term from top),
    pos as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from tok),
    pairs as (select a.word as term, b.word, count(*) as cnt from pos a join terms_ on terms_.term = a.word
              join pos b on a.doc_id = b.doc_id and b.i between a.i - 5 and a.i + 5 and b.i <> a.i group by all),
    ctx as (select word, sum(cnt)::bigint as cnt from pairs group by word),
    sup as (select ctx.* from ctx, n where cnt >= greatest(1, floor(n_docs / 4))),
    tot as (select sum(cnt)::double as total from pairs),
    byt as (select term, sum(cnt) as t_cnt from pairs group by term),
    scored as (select word, sum(case when cnt < total then ln((cnt / total) / ((t_cnt / total) * (w_cnt / total))) / -ln(cnt / total) else 0 end) / (select count(*) from terms_) as npmi
               from pairs join byt using (term) join (select word, cnt as w_cnt from sup) using (word), tot where word not in (select term from terms_) group by word),
    chosen as (select * from scored where npmi > 0 order by round(npmi, 9) desc, word limit 50)"""
SHARED = """
    held as (select distinct doc_id, word from pos where word in (select term from terms_) or word in (select word from chosen)),
    nt as (select word as term, count(*) as n_term from held group by word),
    nw as (select word, count(*) as n_word from held group by word),
    nb as (select a.word as term, b.word, count(*) as n_both from held a join terms_ on terms_.term = a.word join held b on a.doc_id = b.doc_id join chosen on chosen.word = b.word group by all),
    shared as (select terms_.term, chosen.word, coalesce(n_term, 0) as n_term, coalesce(n_word, 0) as n_word, coalesce(n_both, 0) as n_both, n_docs
               from terms_ cross join chosen cross join n left join nt on nt.term = terms_.term left join nw on nw.word = chosen.word left join nb on nb.term = terms_.term and nb.word = chosen.word),
    doc_npmi as (select term, word, case when n_both > 0 and n_both < n_docs then ln((n_both / n_docs) / ((n_term / n_docs) * (n_word / n_docs))) / -ln(n_both / n_docs) else 0 end as npmi from shared)"""
RAKE = rf"""
    st as (select settings_id, list_filter(stoplist, lambda x: x <> '') as stops, threshold, list_filter(delimiters, lambda x: x <> '') as marks,
                  list_aggregate(list_transform(list_sort(list_distinct(list_transform(list_filter(delimiters, lambda x: x <> ''), lambda x: chr((1000 - len(x))::int) || x))),
                                                lambda x: regexp_replace(x[2:], '([!-/:-@\[-`{{-~])', '\\\1', 'g')), 'string_agg', '|') as pat from rake_settings),
    cut as (select settings_id, stops, marks, threshold, doc_id, list_filter(list_transform(string_split(regexp_replace(lower(text), '(' || pat || ')', chr(3) || '\1' || chr(3), 'g'), chr(3)),
                   lambda c: regexp_replace(c, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), lambda c: c <> '') as cs from t, st where text is not null),
    ch as (select settings_id, doc_id, stops, marks, threshold, unnest(range(len(cs))) as pos, unnest(cs) as chunk from cut),
    isl as (select *, list_contains(stops, chunk) or list_contains(marks, chunk) as brk from ch),
    grp as (select *, sum(brk::int) over (partition by settings_id, doc_id order by pos) as g from isl),
    phr as (select settings_id, doc_id, g, list(chunk order by pos) as words from grp where not brk group by all),
    wrd as (select settings_id, doc_id, unnest(words) as word, len(words) - 1 as others from phr),
    wsc as (select settings_id, doc_id, word, count(*) as freq, sum(others)::bigint as degree, sum(others) / count(*) as ratio from wrd group by all),
    lst as (select settings_id, doc_id, array_to_string(words, ' ') as term, arg_max(words, g) as words from phr group by all),
    csc as (select settings_id, doc_id, term, sum(ratio) as score from (select settings_id, doc_id, term, unnest(words) as word from lst) join wsc using (settings_id, doc_id, word) group by all)"""
LINKED = rf"""
    tk as (select settings_id, stops, doc_id, regexp_extract_all(lower(text), '[^{SPACE}]+') as w from t, st where text is not null),
    op as (select *, unnest(range(len(w))) as i, unnest(w) as word from tk),
    fr as (select * from op where not list_contains(stops, word)),
    nx as (select *, lead(i) over (partition by settings_id, doc_id order by i) as j, lead(word) over (partition by settings_id, doc_id order by i) as b from fr),
    lk as (select settings_id, doc_id, word as a, b, word || ' ' || array_to_string(w[i + 2 : j], ' ') || ' ' || b as term from nx where j is not null),
    lsc as (select lk.settings_id, lk.doc_id, lk.term, sum(x.score + y.score) as score from lk join csc x on x.settings_id = lk.settings_id and x.doc_id = lk.doc_id and x.term = lk.a
            join csc y on y.settings_id = lk.settings_id and y.doc_id = lk.doc_id and y.term = lk.b group by all),
    rk as (select settings_id, doc_id, term, coalesce(l.score, c.score) as score from csc c full join lsc l using (settings_id, doc_id, term)),
    kept as (select rk.* from rk join st using (settings_id) where threshold is null or score >= threshold)"""
ALL_TERMS = "alls as (select sum(cf) as n_all from stat)"
KNOWN = "known as (select {key} as term, max(label) as label from term_labels where term is not null and label is not null group by 1)"
FLAG = " or ".join(f"contains(lower(term), '{m}')" for m in MORPHEMES)
SENTENCES = rf"""
    sent0 as (select doc_id, list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(3), 'g'), chr(3)), lambda s: regexp_replace(s, '[{SPACE}]+', '', 'g') <> '') as ss from t where text is not null),
    sent as (select doc_id, unnest(range(len(ss)))::int as sent_no, unnest(ss) as sentence from sent0),
    stok as (select doc_id, sent_no, regexp_extract_all(sentence, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\s\p{{L}}\p{{M}}\p{{N}}_]') as w from sent)"""
TAGS = r"""
    at_ as (select doc_id, sent_no, w, unnest(range(len(w))) as i from stok),
    gram as (select doc_id, sent_no, i, unnest(range(1, least(6, len(w) - i) + 1)) as k, w from at_),
    hit as (select doc_id, sent_no, i, k from gram where lower(array_to_string(w[i + 1 : i + k], ' ')) in (select term from term_labels where term is not null)),
    mk as (select doc_id, sent_no, i, k, unnest(range(i, i + k)) as pos from hit),
    lasts as (select doc_id, sent_no, pos, case when pos = i then 'B-T' else 'T' end as tag from mk qualify row_number() over (partition by doc_id, sent_no, pos order by k desc, i desc) = 1),
    tagged as (select doc_id, sent_no, pos::int as pos, w[pos + 1] as token, coalesce(tag, 'n') as tag from (select doc_id, sent_no, w, i as pos from at_) left join lasts using (doc_id, sent_no, pos)),
    isle as (select *, sum((tag <> 'T')::int) over (partition by doc_id, sent_no order by pos) as g from tagged)"""


def _rounded(value: str, digits: int = 6) -> str:
    return f"round({value}, {digits}) + 0.0"


OFFSETS = f""",
        kept as (select doc_id, term from counts join stat using (term), n where cnt / n_ngrams * {IDF} >= 0.1),
        one as (select doc_id, unnest(w) as term, unnest(s) as x from tok),
        two as (select doc_id, unnest(list_transform(range(1, len(w)), lambda i: {{'term': w[i] || ' ' || w[i + 1], 'start': s[i]."start", 'end': s[i + 1]."end"}})) as x from tok),
        occ as (select doc_id, term, x."start" as start, x."end" as "end" from one union all select doc_id, x.term, x."start", x."end" from two)"""

SQL: dict[str, str] = {
    "tokenize": f"with {FORCE}, {TOKENS} select doc_id, unnest(range(len(w)))::int as pos, unnest(w) as token from tok",
    "span_tokenize": f"with {FORCE}, {SPANS} select doc_id, unnest(range(len(w)))::int as pos, unnest(w) as token from tok",
    "ngrams_1_2": BASE + " select doc_id, n_ngrams, term from cand",
    "ngrams_with_offsets": f"""with {FORCE}, {SPANS},
        one as (select doc_id, unnest(w) as term, unnest(s) as x from tok),
        two as (select doc_id, unnest(list_transform(range(1, len(w)), lambda i: {{'term': w[i] || ' ' || w[i + 1], 'start': s[i]."start", 'end': s[i + 1]."end"}})) as x from tok)
        select doc_id, term, x."start" as start, x."end" as "end" from one union all select doc_id, x.term, x."start", x."end" from two""",
    "whitespace_split": rf"with {FORCE}, w as (select doc_id, regexp_extract_all(lower(text), '[^{SPACE}]+') as w from t where text is not null) select doc_id, unnest(range(len(w)))::int as pos, unnest(w) as word from w",
    "ngrams_rejoined": f"""with {FORCE}, {SPANS} select doc_id, array_to_string(flatten(list_transform(range(1, len(w) + 1),
        lambda i: case when i < len(w) then [w[i], w[i] || ' ' || w[i + 1]] else [w[i]] end)), ' ') as text from tok""",
    "term_counts": BASE + " select doc_id, n_ngrams, term, cnt from counts",
    "tf": BASE + f" select doc_id, term, {_rounded('cnt / n_ngrams')} as tf from counts",
    "document_count": f"with {FORCE}, {NDOCS} select n_docs from n",
    "vocabulary": BASE + " select distinct term from cand",
    "df": BASE + " select term, df from stat",
    "cf": BASE + " select term, cf from stat",
    "ntf": BASE + f", {ALL_TERMS} select term, {_rounded('cf / n_all', 9)} as ntf from stat, alls",
    "idf": BASE + f" select term, {_rounded(IDF)} as idf from stat, n",
    "idf_smooth": BASE + f" select term, {_rounded('ln(1 + n_docs / (1 + df))')} as idf from stat, n",
    "ridf_stat": BASE + f" select term, {_rounded(RIDF)} as ridf from stat, n",
    "ridf_textbook": BASE + f" select term, {_rounded('ln(df / (1 + n_docs * (1 - exp(-(cf / n_docs)))))')} as ridf from stat, n",
    "tfidf": BASE + f" select doc_id, term, {_rounded(f'cnt / n_ngrams * {IDF}')} as score from counts join stat using (term), n",
    "tfidf_threshold": BASE + f" select doc_id, term, {_rounded(f'cnt / n_ngrams * {IDF}')} as score from counts join stat using (term), n where cnt / n_ngrams * {IDF} >= 0.1",
    "tfidf_span": SPAN_BASE + f" select doc_id, term, {_rounded(f'cnt / n_ngrams * {IDF}')} as score from counts join stat using (term), n",
    "tfidf_nested": BASE + f""",
        kept as (select doc_id, term, {_rounded(f'cnt / n_ngrams * {IDF}')} as score from counts join stat using (term), n where cnt / n_ngrams * {IDF} >= 0.1)
        select t.doc_id, case when term is not null then (row_number() over (partition by t.doc_id order by score desc, term) - 1)::int end as pos, term, score from t left join kept using (doc_id)""",
    "tfidf_layer": SPAN_BASE + f"""{OFFSETS}, hit as (select doc_id, term, start, "end" from occ semi join kept using (doc_id, term))
        select sp.doc_id, case when term is not null then (row_number() over (partition by sp.doc_id order by start, "end", term) - 1)::int end as pos, term, start, "end" from sp left join hit using (doc_id)""",
    "tfidf_offsets_semi": SPAN_BASE + f"""{OFFSETS} select doc_id, term, start, "end" from occ semi join kept using (doc_id, term)""",
    "ridf": BASE + f" select doc_id, term, {_rounded(f'cnt / n_ngrams * {RIDF}')} as score from counts join stat using (term), n",
    "ridf_span": SPAN_BASE + f" select doc_id, term, {_rounded(f'cnt / n_ngrams * {RIDF}')} as score from counts join stat using (term), n",
    "weirdness_ntf": BASE + f", {ALL_TERMS}, {REFERENCE} select doc_id, term, {_rounded('(cf / n_all) / greatest(coalesce(ref_cf / ref_all, 1e-9), 1e-9)', 3)} as score from counts join stat using (term) left join rstat using (term), alls, rall",
    "weirdness_idf": BASE + f", {REFERENCE} select doc_id, term, {_rounded('(cnt / n_ngrams) / greatest(coalesce(ln(ref_docs / (1 + ref_df)), 1e-9), 1e-9)', 3)} as score from counts left join rstat using (term), rn",
    "domain_pertinence": BASE + f", {REFERENCE} select doc_id, term, {_rounded(f'cnt / n_ngrams * coalesce(ln(ref_docs / (1 + ref_df)), 0.0) / greatest({IDF}, 1e-9)', 3)} as score from counts join stat using (term) left join rstat using (term), n, rn",
    "relevance": BASE + f", {REFERENCE} select doc_id, term, {_rounded('1 - log2(2 + cnt / n_ngrams * ln(1 + n_docs / (1 + df)) / greatest(coalesce(ln(1 + ref_docs / (1 + ref_df)), 1.0), 1e-9))')} as score from counts join stat using (term) left join rstat using (term), n, rn",
    "containment_pairs": BASE + f", {NESTING} select doc_id, term, container from near",
    "nesting_counts": BASE + f", {NESTING} select doc_id, term, cnt, n_containing, cnt_containing, n_contained from nest",
    "basic": BASE + f", {NESTING} select doc_id, term, {_rounded('k * ln(cnt + 1) + 0.5 * n_containing')} as score from nest",
    "basic_span": SPAN_BASE + f", {NESTING} select doc_id, term, {_rounded('k * ln(cnt + 1) + 0.5 * n_containing')} as score from nest",
    "combobasic": BASE + f", {NESTING} select doc_id, term, {_rounded('k * ln(cnt + 1) + 0.7 * n_containing + 0.3 * n_contained')} as score from nest",
    "cvalue": BASE + f", {NESTING} select doc_id, term, {_rounded('case when k > 0 then log2(k) else 0 end * (cnt - case when n_containing > 0 then cnt_containing / n_containing else 0 end)')} as score from nest",
    "cvalue_span": SPAN_BASE + f", {NESTING} select doc_id, term, {_rounded('case when k > 0 then log2(k) else 0 end * (cnt - case when n_containing > 0 then cnt_containing / n_containing else 0 end)')} as score from nest",
    "basic_top200": BASE + f", {NESTING}, {TOP200} select doc_id, term, {_rounded('s')} as score from top",
    "context_pairs": BASE + f", {NESTING}, {TOP200} select term, word, cnt from pairs",
    "context_counts": BASE + f", {NESTING}, {TOP200} select word, cnt from ctx",
    "context_support_filter": BASE + f", {NESTING}, {TOP200} select word, cnt from sup",
    "context_words": BASE + f", {NESTING}, {TOP200} select word, {_rounded('npmi')} as npmi from chosen",
    "codoc_npmi": BASE + f", {NESTING}, {TOP200}, {SHARED} select term, word, {_rounded('npmi')} as npmi from doc_npmi",
    "domain_coherence_compat": BASE + f", {NESTING}, {TOP200} select term, 0.0::double as score from terms_",
    "domain_coherence_standard": BASE + f", {NESTING}, {TOP200}, {SHARED} select term, {_rounded('avg(npmi)')} as score from doc_npmi group by term",
    "rake_chunks": f"with {FORCE}, {RAKE} select settings_id, doc_id, pos::int as pos, chunk from ch",
    "rake_phrases": f"with {FORCE}, {RAKE} select settings_id, doc_id, array_to_string(words, '|') as phrase, count(*) as n from phr group by all",
    "rake_word_scores": f"with {FORCE}, {RAKE} select settings_id, doc_id, word, freq, degree, {_rounded('ratio')} as ratio from wsc",
    "rake_scores": f"with {FORCE}, {RAKE} select settings_id, doc_id, term, {_rounded('score')} as score from csc",
    "rake_linked": f"with {FORCE}, {RAKE}, {LINKED} select settings_id, doc_id, term, {_rounded('score')} as score from lsc",
    "rake": f"with {FORCE}, {RAKE}, {LINKED} select settings_id, doc_id, term, {_rounded('score')} as score from kept",
    "rake_offsets": f"""with {FORCE}, {RAKE}, {LINKED},
        pc as (select settings_id, doc_id, term, string_split(lower(text), term) as p from kept join t using (doc_id)),
        ix as (select settings_id, doc_id, term, p, unnest(range(1, len(p))) as i from pc)
        select settings_id, doc_id, term, (list_sum(list_transform(p[:i], lambda x: len(x))) + (i - 1) * len(term))::int as start,
               (list_sum(list_transform(p[:i], lambda x: len(x))) + i * len(term))::int as "end" from ix""",
    "label_join": BASE + f", {KNOWN.format(key='term')} select term, coalesce(label, 0) as label from stat left join known using (term)",
    "label_join_normalized": BASE + f", {KNOWN.format(key='lower(trim(term))')} select term, coalesce(label, 0) as label from stat left join known using (term)",
    "mi3_feature": BASE + f", {ALL_TERMS} select term, {_rounded('pow(cf / n_all, 3) / (cf / n_all + 1e-9)', 12)} as mi3 from stat, alls",
    "greek_latin_flag": BASE + f" select term, ({FLAG})::int as greek_latin from stat",
    "roger_features": BASE + f""", {ALL_TERMS}, f as (select term, cf, cf / n_all as f from stat, alls)
        select term, {_rounded('f', 9)} as freq, {_rounded('ln(f + 1e-9)', 9)} as mi, {_rounded('pow(f, 3) / (f + 1e-9)', 9)} as mi3, {_rounded('2 * f / (f + f + 1e-9)', 9)} as dice,
               {_rounded('f * ln(f + 1e-9)', 9)} as log_likelihood, {_rounded('cf * (f * ln(f + 1e-9))', 9)} as occ_log_likelihood, {_rounded('f * ln(f + 1e-9)', 9)} as j_measure,
               {_rounded('f * f', 9)} as khi2, {_rounded('f / sqrt(f + 1e-9)', 9)} as t_test from f""",
    "sentence_split": f"with {FORCE}, {SENTENCES} select doc_id, sent_no, sentence from sent",
    "sentence_groups_span": f"""with {FORCE}, {SPANS}, e as (select doc_id, unnest(range(len(w))) as pos, unnest(w) as token from tok),
        g as (select *, coalesce(sum((token in ('.', '!', '?'))::int) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as sent_no from e)
        select doc_id, sent_no::int as sent_no, count(*)::int as n_tokens, string_agg(token, ' ' order by pos) as sentence from g group by doc_id, sent_no""",
    "find_sublist": f"""with {FORCE}, {SENTENCES}, a as (select doc_id, sent_no, w, w[1:2] as sub, unnest(range(len(w))) as i from stok)
        select doc_id, sent_no, i::int as first, (i + len(sub) - 1)::int as last from a where w[i + 1 : i + len(sub)] = sub""",
    "bio_tags": f"with {FORCE}, {SENTENCES}, {TAGS} select doc_id, sent_no, pos, token, tag from tagged",
    "bio_decode": f"""with {FORCE}, {SENTENCES}, {TAGS},
        gg as (select doc_id, sent_no, g, min(pos) as start, arg_min(tag, pos) as head, lower(string_agg(token, ' ' order by pos)) as term from isle where tag <> 'n' group by all)
        select doc_id, sent_no, start, term from gg where head = 'B-T'""",
    "assign_terms_to_docs": f"with {FORCE}, q as (select distinct lower(term) as term from term_labels where label = 1 and term is not null and term <> '') select doc_id, term from t join q on contains(lower(text), term)",
}
