"""Registered queries of the hand-off operators, with DuckDB SQL for those that SQL can express.

Conversations are messages; documents are payloads, and chains: a chain's
requirements are a document's lines, its stages the document without some of them
(derived, as the tables hold no hand-off chains).
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import prose, tokens
from ..evaluation import experiment, matrix, tasks
from ..operators import compress, dedup, handoff, messages, replay, sessions


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return _table(spark, d, "documents").select("doc_id", "text")


def _conversations(spark, d):
    """Conversations with two paragraphs a message: its text, and a line that recurs."""
    rows = _table(spark, d, "conversations")
    return rows.withColumn("text", F.concat("text", F.lit("\n\nThe plan for part "), (F.col("turn") % 2).cast("string"), F.lit(" of the shared work must be kept by every agent that reads these notes, without any change to the order of its steps or dates.")))


_CONVERSATIONS = "select conv_id, turn, role, text || chr(10) || chr(10) || 'The plan for part ' || (turn % 2)::varchar || ' of the shared work must be kept by every agent that reads these notes, without any change to the order of its steps or dates.' as text from conversations"

_GAP = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"


def _sql_tokens(x):
    return rf"""(case when {x}='' then 0 else greatest(1, round_even(list_reduce(list_prepend(0.0::double, list_transform(regexp_extract_all({x}, '(?s)[A-Za-z]+(?:''[A-Za-z]+)?|\p{{Nd}}+|{_GAP}+|.'), lambda t: (case when regexp_matches(t,'^[A-Za-z]') then 1+(length(t)-1)//7 when regexp_matches(t,'^\p{{Nd}}') then 1+(length(t)-1)//3 when regexp_matches(t,'^{_GAP}') then length(t)//4 else 0.7 end)::double)), lambda a,b: a+b), 0))::bigint end)::bigint"""


def token_count_documents(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tokens.heuristic_tokens(F.col("text")).alias("tokens"))


def tokens_by_role(spark, d):
    rows = _table(spark, d, "conversations").select("role", tokens.heuristic_tokens(F.col("text")).alias("tokens"))
    return rows.groupBy("role").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"))


def edge_profile(spark, d):
    return messages.edge_profile(_table(spark, d, "conversations"))


def edge_cost(spark, d):
    return messages.with_edges(_table(spark, d, "conversations")).groupBy("edge").agg(F.round(F.sum("cost"), 9).alias("cost"))


def model_profiles(spark, d):
    models = [(m,) for m in ("gpt-4.1-mini-2025", "GPT-4.1", "gpt-4o-x", "o3-pro", "claude-opus-4-1", "claude-2", "other")]
    profile = tokens.model_profile(F.col("model"))
    return spark.createDataFrame(models, "model string").select("model", tokens.model_family(F.col("model")).alias("family"), profile["model"].alias("profile"), profile["input_price"].alias("input_price"))


def eligible_payloads(spark, d):
    text, role = F.col("text"), F.col("role")
    return _table(spark, d, "conversations").select("conv_id", "turn", messages.payload_eligible(role, text).alias("eligible"))


def structured_pages(spark, d):
    return _table(spark, d, "pages").select("page_id", messages.looks_structured(F.col("html")).alias("structured"))


def structured_events(spark, d):
    rows = _table(spark, d, "events").select(messages.looks_structured(F.col("props")).alias("structured"))
    return rows.groupBy("structured").agg(F.count("*").alias("events"))


def whitespace_normalize(spark, d):
    return _docs(spark, d).select("doc_id", prose.normalize_whitespace(F.concat(F.col("text"), F.lit("  \n\n\n\nx  y"))).alias("text"))


def filler_strip(spark, d):
    return _docs(spark, d).select("doc_id", prose.remove_fillers(F.concat(F.lit("Please note that basically, "), F.col("text"))).alias("text"))


def content_words(spark, d):
    words = prose.content_words(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(words).cast("long").alias("n_words"), F.array_join(F.array_sort(words), ",").alias("words"))


def qualifiers(spark, d):
    decorated = F.concat(F.lit("It is very much, really and Simply "), F.col("text"))
    return _docs(spark, d).select("doc_id", F.array_join(prose.qualifier_sequence(decorated), ",").alias("qualifiers"))


def telegraph_text(spark, d):
    return _docs(spark, d).select("doc_id", prose.telegraph(F.col("text")).alias("text"))


def sentence_salience(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(prose.sentences(F.col("text"))).alias("idx", "sentence"))
    return rows.select("doc_id", "idx", F.round(prose.salience(F.col("sentence")), 3).alias("salience"))


def segment_rows(spark, d):
    decorated = F.concat(F.col("text"), F.lit("\n\n| a | b |\n| 1 | 2 |\n\n```\ncode\n\nmore\n```\nend"))
    return _docs(spark, d).select("doc_id", F.posexplode(messages.segments(decorated)).alias("idx", "s")).select("doc_id", "idx", "s.kind", "s.text")


def block_rows(spark, d):
    return dedup.block_rows(_conversations(spark, d))


def content_store(spark, d):
    return dedup.content_store(dedup.block_rows(_conversations(spark, d)))


def store_hits(spark, d):
    return dedup.store_hits(dedup.block_rows(_conversations(spark, d))).select("conv_id", "turn", "block_idx", "sha")


def context_hits(spark, d):
    return dedup.context_hits(dedup.block_rows(_conversations(spark, d))).select("conv_id", "turn", "block_idx", "reference")


def _chains(spark, d):
    lines = _docs(spark, d).select(F.col("doc_id").alias("chain_id"), F.posexplode(F.split("text", "\n")).alias("ord", "quote")).filter("quote <> ''")
    needs = lines.select("chain_id", "ord", F.col("ord").cast("string").alias("requirement_id"), F.lit("e").alias("evidence_id"), F.lit("doc").alias("source"), "quote")
    kept = lines.crossJoin(F.broadcast(spark.range(3).select(F.col("id").cast("int").alias("idx"))))
    kept = kept.filter("idx = 0 or ord % (idx + 2) <> chain_id % (idx + 2)")
    texts = kept.groupBy("chain_id", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "quote"))), lambda x: x["quote"]), "\n").alias("text"))
    return needs, texts.select("chain_id", "idx", F.concat(F.lit("stage"), F.col("idx").cast("string")).alias("stage"), "text")


_CHAINS = """lines as (select doc_id as chain_id, unnest(range(len(l))) as ord, unnest(l) as quote from (select doc_id, string_split(text, chr(10)) as l from documents)),
needs as (select * from lines where quote <> ''),
stages as (select chain_id, idx, 'stage' || idx::varchar as stage, string_agg(quote, chr(10) order by ord) as text from needs, (select unnest([0,1,2]) as idx) where idx = 0 or ord % (idx + 2) <> chain_id % (idx + 2) group by all),
audited as (select n.chain_id, n.ord::varchar as requirement_id, s.idx, s.stage, contains(s.text, n.quote) as present from needs n join stages s using (chain_id))"""


def audit_presence(spark, d):
    return handoff.audit(*_chains(spark, d)).groupBy("chain_id", "idx").agg(F.count_if("present").alias("present"), F.count_if(~F.col("present")).alias("missing"))


def audit_losses(spark, d):
    return handoff.losses(handoff.audit(*_chains(spark, d)))


def repair_chains(spark, d):
    return handoff.repair(*_chains(spark, d)).select("chain_id", "idx", "n_restored", F.sha2(F.col("repaired").cast("binary"), 256).alias("sha256"))


def evidence_hashes(spark, d):
    return handoff.evidence_hashes(_table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))


def _compressed(strategy, keep):
    def query(spark, d):
        out = _table(spark, d, "conversations").withColumn("after", compress.compress(F.col("text"), strategy, keep))
        return out.select("conv_id", "turn", tokens.heuristic_tokens(F.col("text")).alias("tokens_before"), tokens.heuristic_tokens(F.col("after")).alias("tokens_after"), "after")

    return query


def _raw(spark, d):
    """Conversations as raw messages; source and target are the roles of a message and of the next one."""
    rows = _conversations(spark, d)
    following = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select("conv_id", "turn", F.col("role").alias("source"), following.alias("target"), F.to_json(F.struct("role", F.col("text").alias("content"))).alias("raw"))


def _session(strategy, **settings):
    def query(spark, d):
        rows = _raw(spark, d).select("conv_id", "turn", "raw")
        done = sessions.process(rows, sessions.Processor("gpt-4.1", strategy, dedup=None, **settings))
        return done.select("conv_id", "turn", "tokens_before", "tokens_after", "fell_back", "fallback_reason", "sent")

    return query


def session_off(spark, d):
    done = sessions.process(_raw(spark, d), sessions.Processor("gpt-4.1", "off"))
    return done.select("conv_id", "turn", "tokens_before", "tokens_after", "fell_back", (F.col("sent") == F.col("raw")).alias("unchanged"))


def session_store(spark, d):
    """Blocks that a session with a store of blocks replaces."""
    return sessions.process_all(_raw(spark, d), sessions.Processor("gpt-4.1", compressor=lambda text, keep: text, dedup="store")).select("conv_id", "turn", "dedup_hits")


def session_new(spark, d):
    """Blocks of a conversation's last message that its history holds."""
    return sessions.process_new(_raw(spark, d), sessions.Processor("gpt-4.1", compressor=lambda text, keep: text)).select("conv_id", "turn", "dedup_hits")


def session_all(spark, d):
    done = sessions.process_all(_raw(spark, d), sessions.Processor("gpt-4.1", "conservative"))
    return done.select("conv_id", "turn", "tokens_before", "tokens_after", "dedup_hits", "sent")


def profile_by_edge(spark, d):
    done = sessions.process(_raw(spark, d), sessions.Processor("gpt-4.1", "off"), keys=("conv_id", "turn", "source", "target"))
    return sessions.by_edge(sessions.records(done))


def profile_totals(spark, d):
    done = sessions.process(_raw(spark, d), sessions.Processor("gpt-4.1", "off"), keys=("conv_id", "turn", "source", "target"))
    return sessions.totals(sessions.records(done)).select("tokens_before", "tokens_after", "tokens_saved", "overall_ratio", "fallbacks", "handoffs", F.array_join("tiers", ",").alias("tiers"))


def matrix_summary(spark, d):
    """The study over the tasks of seed 7, which no table holds."""
    made = matrix.summarize(matrix.run(tasks.generate(spark)))
    return made.select("strategy", "keep_ratio", "tasks", F.round("accuracy", 3).alias("accuracy"), F.round("mean_token_ratio", 3).alias("mean_token_ratio"))


def safe_points(spark, d):
    made = matrix.safe_points(matrix.summarize(matrix.run(tasks.generate(spark))))
    return made.select("strategy", "keep_ratio", F.round("accuracy", 3).alias("accuracy"), F.round("mean_token_ratio", 3).alias("mean_token_ratio"))


def experiment_statuses(spark, d):
    return experiment.status_counts(experiment.replays(experiment.cases(spark)))


def experiment_policies(spark, d):
    return experiment.policy_totals(experiment.outcomes(experiment.cases(spark))).select("policy", "passed", "cases")


def experiment_calls(spark, d):
    return experiment.replay_totals(experiment.replays(experiment.cases(spark))).select("passed", "repaired", "calls")


def _contracts(spark, d):
    """A contract an item: the item's text is its evidence, its sentences are requirements, and every third item's first quote is not in it."""
    text = F.col("text")
    parts = F.transform(F.split(text, r"\. "), lambda q, k: F.struct(k.cast("string").alias("id"), F.lit("e").alias("evidence_id"), F.when((k == 0) & (F.col("item_id") % 3 == 0), F.concat(q, F.lit("#"))).otherwise(q).alias("quote")))
    parts = F.filter(parts, lambda r: r["quote"] != "")
    evidence = F.array(F.struct(F.lit("e").alias("id"), text.alias("text"), F.lit("item").alias("source")))
    return _table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("trace_id"), evidence.alias("evidence"), parts.alias("requirements"), text.alias("original"), F.left(text, (F.length(text) / 2).cast("int")).alias("candidate"))


def contract_violations(spark, d):
    return replay.violations(_contracts(spark, d))


def capped_repair(spark, d):
    done = replay.repair(_contracts(spark, d), max_added_tokens=60)
    return done.select("trace_id", "text", "restored_ids", "unresolved_ids", "added_tokens", "contract_sha256", "error")


def replayed_contracts(spark, d):
    """Replay with a judge that wants an even or a long enough text, so that all phases occur."""
    judge = lambda text: (len(text) > 150, {"chars": float(len(text))}, "")
    return replay.diagnose(_contracts(spark, d), judge).select("trace_id", "status", "text", "success", "added_ids", "evaluations_used", "added_tokens", "reason")


QUERIES = {
    f.__name__: f
    for f in (
        token_count_documents, tokens_by_role, edge_profile, edge_cost, model_profiles, eligible_payloads, structured_pages, structured_events, whitespace_normalize,
        filler_strip, content_words, qualifiers, telegraph_text, sentence_salience, segment_rows, block_rows, content_store, store_hits, context_hits,
        audit_presence, audit_losses, repair_chains, evidence_hashes,
        session_off, session_store, session_new, session_all, profile_by_edge, profile_totals, contract_violations, capped_repair, replayed_contracts,
        matrix_summary, safe_points, experiment_statuses, experiment_policies, experiment_calls,
    )
} | {"compress_conservative": _compressed("conservative", None), "compress_budgeted": _compressed("budgeted", 0.75), "compress_telegraphic": _compressed("telegraphic", None), "compress_naive": _compressed("naive", 0.75), "session_conservative": _session("conservative"), "session_telegraphic": _session("telegraphic"), "session_balanced": _session("balanced"), "session_aggressive": _session("aggressive")}

_STRUCTURED = r"(regexp_matches({0}, '^\s*[\[{{]') or regexp_matches({0}, '^\s*<[a-zA-Z][^>]*>'))"
_BLOCKS = f"""b as (select conv_id, turn, unnest(range(len(l)))::int as block_idx, unnest(l) as block from (select conv_id, turn, regexp_split_to_array(text, '\\n[ \\t]*\\n') as l from ({_CONVERSATIONS}))),
blocks as (select *, sha256(block) as sha, {_sql_tokens("block")} as tokens from b)"""
_EDGES = f"""edges as (select coalesce(nullif(role,''),'?') || '->' || coalesce(nullif(target,''),'?') as edge, {_sql_tokens("raw")} as tokens from (select role, lead(role) over (partition by conv_id order by turn) as target, to_json({{'role': role, 'content': text}})::varchar as raw from conversations))"""

_HANDLE = "('[ref lc:' || left(sha, 10) || ': call rehydrate(''lc:' || left(sha, 10) || ''') for the full content]')"

_SEEN = "('[ref lc:' || left(sha, 10) || ': see earlier message ' || (place // 1000000 + 1)::varchar || ', paragraph ' || (place % 1000000 + 1)::varchar || ']')"


def _sql_fillers(text):
    for pattern in prose.FILLERS:
        text = f"regexp_replace({text}, '(?i){pattern}', '', 'g')"
    return text


_RAW = f"raws as (select conv_id, turn, role, text, {_sql_tokens("to_json({'role': role, 'content': text})::varchar")} as n, coalesce(nullif(role,''),'?') || '->' || coalesce(nullif(lead(role) over (partition by conv_id order by turn),''),'?') as edge, length(text) >= 80 and role in ('user','assistant','system','developer') and not {_STRUCTURED.format('text')} as open from ({_CONVERSATIONS}))"
_OPEN_BLOCKS = f"{_RAW}, {_BLOCKS}, cand as (select b.*, row_number() over (partition by b.conv_id, b.sha order by b.turn, b.block_idx) as seen from blocks b join raws using (conv_id, turn) where open and b.tokens >= 25)"

_CONTRACTS = """parts as (select item_id, text, len(string_split(text, '. ')) as n, unnest(range(len(string_split(text, '. ')))) as k, unnest(string_split(text, '. ')) as q from benchmark),
quotes as (select item_id, text, k, case when k = 0 and item_id % 3 = 0 then q || '#' else q end as quote from parts)"""

_LIST = lambda words: ",".join("'" + w.replace("'", "''") + "'" for w in words)
_EDGE = """[.,;:!?()"'']+"""
_TELEGRAPH = f"""with pieces as (select doc_id, regexp_split_to_array(text, '{_GAP}+') as w, regexp_extract_all(text, '{_GAP}+') as g from documents),
built as (select doc_id, array_to_string(list_transform(range(1, len(w) + 1), lambda i: (case when w[i] in ({_LIST(prose.DROPPABLE)}) and not coalesce(lower(regexp_replace(w[i - 1], '^{_EDGE}|{_EDGE}$', '', 'g')) in ({_LIST(prose.NEGATIONS)}), false) then '' else w[i] end) || coalesce(g[i], '')), '') as t from pieces)
select doc_id, regexp_replace(regexp_replace(t, '[ \\t]{{2,}}', ' ', 'g'), ' ([.,;:!?])', '\\1', 'g') as text from built"""
_NEEDED = prose.REQUIREMENTS.replace(r"(?iu)(?U)\b", r"(?i)(?:^|[^\pL\pN_])").removesuffix(r"\b") + r"(?:$|[^\pL\pN_])"
_SALIENCE = rf"""with s as (select doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+([A-Z"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) as l from documents),
x as (select doc_id, unnest(range(len(l)))::int as idx, unnest(l) as t from s)
select doc_id, idx, round(case when regexp_matches(t, '\p{{Nd}}') then 0.6::double else 0 end + case when regexp_matches(t, '{_NEEDED}') then 0.6::double else 0 end + case when regexp_matches(t, '[a-z,;] [A-Z][a-z]+') then 0.3::double else 0 end, 3) as salience from x"""
_REPAIRED = f"""with {_CHAINS}, lost as (select s.chain_id, s.idx, n.ord, n.quote from stages s join needs n using (chain_id) where not contains(s.text, n.quote)),
kept as (select * from lost l where not exists (select 1 from lost e where e.chain_id = l.chain_id and e.idx = l.idx and e.ord < l.ord and contains(e.quote, l.quote))),
grown as (select chain_id, idx, string_agg(chr(10) || chr(10) || '[Source clause {{"requirement": "' || ord::varchar || '", "evidence": "e", "source": "doc"}}]' || chr(10) || quote, '' order by ord) as more from kept group by all),
missed as (select chain_id, idx, count(*) as n from lost group by all)
select chain_id, idx, coalesce(n, 0) as n_restored, sha256(text || coalesce(more, '')) as sha256 from stages left join missed using (chain_id, idx) left join grown using (chain_id, idx)"""
_PROFILES = f"""with m as (select unnest(['gpt-4.1-mini-2025', 'GPT-4.1', 'gpt-4o-x', 'o3-pro', 'claude-opus-4-1', 'claude-2', 'other']) as model),
p as (select * from (values {",".join(f"('{n}', {price}::double)" for n, _, price, _, _ in tokens.PRICES)}) t(name, price))
select model, case when regexp_matches(lower(model), '^({"|".join(tokens.OPENAI_PREFIXES)})') then 'openai' when starts_with(lower(model), 'claude') then 'anthropic' else 'unknown' end as family, arg_max(name, length(name)) as profile, arg_max(price, length(name)) as input_price
from m left join p on starts_with(lower(model), name) group by model"""

_SEGMENTS = rf"""with d as (select doc_id, text || chr(10) || chr(10) || '| a | b |' || chr(10) || '| 1 | 2 |' || chr(10) || chr(10) as body from documents),
split as (select doc_id, regexp_split_to_array(body, '\n[ \t]*\n') as p, regexp_extract_all(body, '\n[ \t]*\n') as g from d),
mixed as (select doc_id, list_filter(flatten(list_transform(range(1, len(p) + 1), lambda i: [p[i], coalesce(g[i], '')])), lambda x: x <> '') as l from split),
listed as (select doc_id, list_concat(list_transform(l, lambda x: {{'kind': case when regexp_matches(x, '^\s*\|[^\n]*\n[ \t]*\|') then 'protected' else 'text' end, 'text': x}}), [{{'kind': 'protected', 'text': '```' || chr(10) || 'code' || chr(10) || chr(10) || 'more' || chr(10) || '```'}}, {{'kind': 'text', 'text': chr(10) || 'end'}}]) as l from mixed)
select doc_id, (unnest(range(len(l))))::int as idx, unnest(list_transform(l, lambda x: x.kind)) as kind, unnest(list_transform(l, lambda x: x.text)) as text from listed"""

ORACLE_SQL = {
    "segment_rows": _SEGMENTS,
    "telegraph_text": _TELEGRAPH,
    "sentence_salience": _SALIENCE,
    "repair_chains": _REPAIRED,
    "model_profiles": _PROFILES,
    "session_off": f"with {_RAW} select conv_id, turn, n as tokens_before, n as tokens_after, false as fell_back, true as unchanged from raws",
    "session_store": f"with {_OPEN_BLOCKS} select r.conv_id, r.turn, count(c.sha) as dedup_hits from raws r left join cand c on r.conv_id = c.conv_id and r.turn = c.turn and c.seen > 1 and {_sql_tokens(_HANDLE)} < c.tokens group by all",
    "session_new": f"with {_OPEN_BLOCKS}, last as (select conv_id, max(turn) as turn, count(*) as n from raws group by conv_id), found as (select c.*, (select max(h.turn * 1000000 + h.block_idx) from blocks h where h.conv_id = c.conv_id and h.sha = c.sha and h.turn < c.turn) as place from cand c join last using (conv_id, turn)), worth as (select * from found where place is not null and {_sql_tokens(_SEEN)} < tokens) select l.conv_id, l.turn, count(w.sha) as dedup_hits from last l left join worth w using (conv_id, turn) group by all",
    "profile_by_edge": f"with {_RAW} select edge, count(*) as handoffs, sum(n)::bigint as tokens_before, sum(n)::bigint as tokens_after, 0::bigint as fallbacks from raws group by edge",
    "profile_totals": f"with {_RAW} select sum(n)::bigint as tokens_before, sum(n)::bigint as tokens_after, 0::bigint as tokens_saved, 1.0::double as overall_ratio, 0::bigint as fallbacks, count(*) as handoffs, 'estimate' as tiers from raws",
    "contract_violations": f"with {_CONTRACTS} select item_id::varchar as trace_id, 'quote not in evidence' as kind, k::varchar as id from quotes where quote <> '' and not contains(text, quote)",
    "filler_strip": f"select doc_id, {_sql_fillers("'Please note that basically, ' || text")} as text from documents",
    "qualifiers": "select doc_id, lower(array_to_string(regexp_extract_all('It is very much, really and Simply ' || text, '(?i)\\b(?:" + "|".join(prose.QUALIFIERS) + ")\\b'), ',')) as qualifiers from documents",
    "token_count_documents": f"select doc_id, {_sql_tokens('text')} as tokens from documents",
    "tokens_by_role": f"select role, count(*) as messages, sum({_sql_tokens('text')})::bigint as tokens from conversations group by role",
    "edge_profile": f"with {_EDGES} select edge, count(*) as handoffs, sum(tokens)::bigint as tokens_before from edges group by edge",
    "edge_cost": f"with {_EDGES} select edge, round(sum(tokens * 2.0::double / 1000000), 9) as cost from edges group by edge",
    "eligible_payloads": f"select conv_id, turn, length(text) >= 80 and role in ('user','assistant','system','developer') and not {_STRUCTURED.format('text')} as eligible from conversations",
    "structured_pages": f"select page_id, {_STRUCTURED.format('html')} as structured from pages",
    "structured_events": f"select {_STRUCTURED.format('props')} as structured, count(*) as events from events group by 1",
    "whitespace_normalize": r"select doc_id, regexp_replace(regexp_replace(regexp_replace(text || '  ' || repeat(chr(10), 4) || 'x  y', '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g') as text from documents",
    "content_words": "select doc_id, len(w)::bigint as n_words, array_to_string(w, ',') as words from (select doc_id, list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: x not in (" + ",".join(f"'{w}'" for w in prose.STOP_WORDS) + "))) as w from documents)",
    "block_rows": f"with {_BLOCKS} select * from blocks",
    "content_store": f"with {_BLOCKS} select conv_id, sha, min(block) as block, 'lc:' || left(sha, 10) as handle from blocks group by conv_id, sha",
    "store_hits": f"with {_BLOCKS} select conv_id, turn, block_idx, sha from (select *, row_number() over (partition by conv_id, sha order by turn, block_idx) as seen from blocks) where seen > 1 and tokens >= 25 and {_sql_tokens(_HANDLE)} < tokens",
    "context_hits": f"with {_BLOCKS}, hits as (select x.conv_id, x.turn, x.block_idx, x.sha, x.tokens, max(h.turn) as h_turn from blocks x join blocks h on x.conv_id = h.conv_id and x.sha = h.sha and h.turn < x.turn where x.tokens >= 25 group by all), placed as (select hits.*, (select max(block_idx) from blocks b where b.conv_id = hits.conv_id and b.sha = hits.sha and b.turn = h_turn) as h_block from hits), r as (select *, '[ref lc:' || left(sha, 10) || ': see earlier message ' || (h_turn + 1)::varchar || ', paragraph ' || (h_block + 1)::varchar || ']' as reference from placed) select conv_id, turn, block_idx, reference from r where {_sql_tokens('reference')} < tokens",
    "audit_presence": f"with {_CHAINS} select chain_id, idx, count(*) filter (present) as present, count(*) filter (not present) as missing from audited group by all",
    "audit_losses": f"with {_CHAINS} select chain_id, requirement_id, min(idx) filter (not present) as first_missing, arg_min(stage, idx) filter (not present) as first_missing_stage, arg_max(present, idx) as final_present from audited group by all",
    "evidence_hashes": "select item_id as id, sha256(text) as sha256 from benchmark",
}
