"""DuckDB SQL of the text queries that SQL can express, with the same columns."""

from __future__ import annotations

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

EMBEDDINGS = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98
), reach(node, low) as (
  select vec_id, vec_id from embeddings
  union
  select links.b, reach.low from reach join links on links.a = reach.node where reach.low < links.b
), roots as (select node, min(low) as root from reach group by node),
counts as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(n, 0) as n_links, coalesce(root, e.vec_id) as component_id, coalesce(e.vec_id = root, false) as kept
from embeddings e left join roots on roots.node = e.vec_id left join counts on counts.a = e.vec_id
"""

_WORD = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"


#: Label; wording; required words; excluded words. Written out here, so that the query is held against another source than its own.
_TEMPLATES = """
mit; released under the mit license; mit license;
mit; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction; permission granted software;
apache-2; licensed under the apache license version 2 0; apache 2;
apache-2; licensed under the apache license version 2 0 you may not use this file except in compliance with the license; apache 2;
cc-by-nc; licensed under cc by nc 4 0; cc by nc; nd sa
cc-by-nc; licensed under a creative commons attribution noncommercial 4 0 international license; commons noncommercial; sharealike noderivatives
gpl-3; this work is licensed under the gnu general public license version 3; gnu general 3; lesser affero
gpl-2; this work is licensed under the gnu general public license version 2; gnu general 2; lesser affero
gpl-3; under the terms of the gnu general public license as published by the free software foundation either version 3 of the license; gnu general 3; lesser affero
gpl-2; under the terms of the gnu general public license as published by the free software foundation either version 2 of the license; gnu general 2; lesser affero
lgpl-3; this work is licensed under the gnu lesser general public license version 3; gnu lesser 3;
mpl-2; this source code form is subject to the terms of the mozilla public license v 2 0; mozilla 2;
cc-by-sa; licensed under a creative commons attribution share alike 4 0 international license; commons share alike; noncommercial
cc-by-sa; licensed under a creative commons attribution sharealike 4 0 international license; commons sharealike; noncommercial
cc0; to the extent possible under law the author has waived all copyright and related rights; waived copyright;
mit; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software; permission substantial portions;
isc; released under the isc license; isc license;
isc; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies; permission fee appear; documentation
bsd; released under the bsd license; bsd license;
bsd; redistribution and use in source and binary forms with or without modification are permitted; redistribution binary;
bsd-2; in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is; distribution contributors provided; neither
bsd-3; neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission; neither endorse contributors;
bsd-4; all advertising materials mentioning features or use of this software must display the following acknowledgement; advertising acknowledgement;
agpl-3; this work is licensed under the gnu affero general public license version 3; affero 3;
agpl-3; under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license; affero 3;
lgpl-3; under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license; lesser 3;
lgpl-2.1; under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license; lesser 2 1;
epl-2; made available under the terms of the eclipse public license 2 0; eclipse 2;
mpl-2; licensed under the mozilla public license version 2 0; mozilla 2;
cc-by; licensed under a creative commons attribution 4 0 international license; commons attribution; noncommercial sharealike noderivatives share alike
cc-by-nc-nd; licensed under cc by nc nd 4 0; cc by nc nd;
cc-by-nc-nd; licensed under a creative commons attribution noncommercial noderivatives 4 0 international license; commons noncommercial noderivatives; sharealike
cc-by-nc-sa; licensed under cc by nc sa 4 0; cc by nc sa;
cc-by-nc-sa; licensed under a creative commons attribution noncommercial sharealike 4 0 international license; commons noncommercial sharealike; noderivatives
unlicense; this is free and unencumbered software released into the public domain; unencumbered domain;
zlib; this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software; express warranty authors;
"""


def _list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]::varchar[]"


def _template_values() -> str:
    rows = [[part.strip() for part in line.split(";")] for line in _TEMPLATES.strip().splitlines()]
    return ", ".join(f"('{label}', {_list(wording)}, {_list(required)}, {_list(excluded)})" for label, wording, required, excluded in rows)


LICENSES = f"""
with d as (select row_number() over () as rid, doc_id, translate(coalesce(text, ''), {_ABC}) as t from documents),
w as (select rid, doc_id, regexp_extract_all(t, {_WORD}) as ws from d),
phrases(label, p) as (values ('mit', {_list("under the mit license")}), ('apache-2', {_list("apache license version 2")}), ('cc-by-nc', {_list("cc by nc")})),
places as (select rid, label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1 : i + len(p)] = p)) as place from w, phrases where list_has_all(ws, p)),
base as (select rid, count(*) as n, min(place) as low, max(place) as high, list(distinct label) as labels from places group by rid),
template(label, wording, required, excluded) as (values {_template_values()}),
blocks as (
  select rid, label, list_distinct(wording) as words, required, excluded,
    unnest(list_transform(range(greatest(len(ws) - len(wording), 0) + 1), lambda i: ws[i + 1 : i + len(wording)])) as b
  from w, template where list_has_all(ws, required)
), met as (
  select rid, label, len(list_intersect(words, b)) / len(words)::double as sim from blocks
  where list_has_all(b, required) and not list_has_any(b, excluded) and len(list_intersect(words, b)) >= ceil(0.8 * len(words) - 1e-9)
), more as (select rid, list(distinct label) as labels, max(sim) as best from met group by rid)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_base, low as first_word, high as last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') as labels,
  case when n > 0 then 1.0::double else coalesce(more.best, 0)::double end as score
from w left join base using (rid) left join more using (rid)
"""


def _weight(weights: dict, level: str) -> str:
    return "case " + " ".join(f"when {level} = '{n}' then {w}" for n, w in weights[level].items()) + " else 1 end" if weights.get(level) else "1"


def _share(name: str, children: str, parent: str, level: str) -> str:
    """``children`` has capacity, weight and wanted (the parent's budget); ``name`` adds budget."""
    before = f"(partition by {parent} order by ratio, {level} rows between unbounded preceding and 1 preceding)"
    return f"""
{name}_a as (select *, capacity::double / weight as ratio from ({children})),
{name}_b as (
  select *, (sum(weight) over (partition by {parent}) - coalesce(sum(weight) over {before}, 0))::double as w_left,
    (wanted - coalesce(sum(capacity) over {before}, 0))::double as left_over
  from {name}_a),
{name}_c as (select *, ratio * w_left <= left_over as is_full from {name}_b),
{name} as (
  select * exclude (wanted), case when is_full then capacity::bigint else floor(
    weight * max(left_over) filter (where not is_full) over (partition by {parent}) / max(w_left) filter (where not is_full) over (partition by {parent}))::bigint end as budget
  from {name}_c)"""


def mixing_sql(weights: dict, total_share: float, max_epochs: int, seed: int) -> str:
    domains = f"select 0 as tree, domain, sum(capacity) as capacity, {_weight(weights, 'domain')} as weight, least(floor({total_share!r}::double * (select sum(tokens) from leaf)), (select sum(capacity) from leaf)) as wanted from leaf group by domain"
    langs = f"select leaf.domain, lang, sum(leaf.capacity) as capacity, {_weight(weights, 'lang')} as weight, any_value(budget) as wanted from leaf join by_domain using (domain) group by leaf.domain, lang"
    sources = f"select leaf.domain, leaf.lang, source, tokens, leaf.capacity, {_weight(weights, 'source')} as weight, budget as wanted from leaf join by_lang using (domain, lang)"
    return f"""
with d as (
  select doc_id, lang, source, coalesce(doc_id::varchar, '-' || md5(coalesce(text, ''))) as name, coalesce(lang, '-') as lang_, coalesce(source, '-') as source_,
    len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '')) as n
  from documents),
docs as (
  select *, case when digits = '' then 'd0' else 'd' || (digits::bigint % 4) end as domain
  from (select *, regexp_extract(source_, '([0-9]{{1,9}})$', 1) as digits from d)),
leaf as (select domain, lang_ as lang, source_ as source, sum(n)::bigint as tokens, sum(n)::bigint * {max_epochs} as capacity from docs group by all),
{_share("by_domain", domains, "tree", "domain")},
{_share("by_lang", langs, "domain", "lang")},
{_share("by_source", sources, "domain, lang", "source")},
taken as (select domain, lang, source, tokens, budget, case when tokens > 0 then least({max_epochs}, budget // tokens) else {max_epochs} end as whole from by_source),
placed as (
  select docs.doc_id, docs.lang, docs.source, n, whole, budget - whole * tokens as rest,
    sum(n) over (partition by docs.domain, lang_, source_ order by md5('{seed}:' || whole || ':' || name), n rows unbounded preceding) as run
  from docs join taken on docs.domain = taken.domain and lang_ = taken.lang and source_ = taken.source)
select doc_id, unnest(range(whole))::int as epoch, lang, source, n::bigint as n_tokens from placed
union all
select doc_id, whole::int, lang, source, n::bigint from placed where whole < {max_epochs} and run <= rest
"""


FILTERS = """
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws, min(doc_id) over (partition by t) as first_id from d),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
failed as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, case when len(ws) < 50 then 'A' else '' end
    || case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 'B' else '' end
    || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end || case when w.doc_id > first_id then 'E' else '' end as fails
  from w left join marks using (doc_id)),
kinds as (select part, good, toxic, fails, count(*) as n from failed group by all),
letters(x) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select filter_order, step, filter_order[step] as letter, filter_order[1:step - 1] as before from orders, range(1, 6) s(step)),
fate as (
  select part, filter_order, step, letter, n, good, toxic, fails, contains(fails, letter) as here,
    len(list_filter(string_split(before, ''), lambda x: x <> '' and contains(fails, x))) > 0 as gone
  from kinds, steps),
counted as (
  select part, filter_order, step::int as step, letter, coalesce(sum(n) filter (where not here and not gone), 0)::bigint as kept,
    coalesce(sum(n) filter (where here and not gone), 0)::bigint as removed, coalesce(sum(n) filter (where here and gone), 0)::bigint as redundant,
    coalesce(sum(n) filter (where fails = letter), 0)::bigint as unique_fails, coalesce(sum(n) filter (where here and not gone and good = 1), 0)::bigint as good_lost,
    coalesce(sum(n) filter (where here and not gone and toxic = 1), 0)::bigint as toxic_lost
  from fate group by all)
select * exclude (letter), (sum(removed) over (partition by part, letter))::bigint as shapley from counted
"""
