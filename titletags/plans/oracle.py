"""SQL counterparts of `queries`, for an engine that reads the same parquet tables."""

from __future__ import annotations

from titletags.functions.labels import TAGS_OF_INTEREST, label_rows


def _values() -> str:
    def text(x):
        return "null" if x is None else f"'{x}'"

    return ", ".join(
        f"({i}, {text(label)}, {text(base)}, {int(inner)}, {text(english)})"
        for i, label, base, inner, english in label_rows()
    )


# Derived tables, in the order in which they build on each other.
VIEWS = {
    "dim": f"""select * from (values {_values()}) d(label_id, label, base, is_inner, english)""",
    "v_rec": """
        select x.rn as record_number, p_brand, split_part(p_name,' ',1) as w1,
               split_part(p_name,' ',2) as w2, p_type, p_size
        from (select (l_orderkey*10+l_linenumber)*16 + row_number() over (
                       partition by l_orderkey*10+l_linenumber
                       order by l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as rn,
                     l_partkey as pk from lineitem) x
        join part on x.pk = p_partkey""",
    "v_tagged": """
        select record_number, pos, token, tag, record_number*16+pos as row_idx from (
          select record_number, 0 as pos, p_brand as token,
                 case when record_number%97=0 then null else 'Marke' end as tag from v_rec
          union all select record_number, 1, w1,
                 case when w1 in ('red','blue') then 'Farbe' else 'Modell' end from v_rec
          union all select record_number, 2, w2,
                 case when w1 in ('red','blue') then 'Modell' else null end from v_rec
          union all select record_number, 3, p_type, 'Produktart' from v_rec
          union all select record_number, 4, 'Gr.', 'No Tag' from v_rec
          union all select record_number, 5, 'EU', null from v_rec where p_size%2=0
          union all select record_number, 6, cast(p_size as varchar), 'EU-Schuhgröße'
                 from v_rec) t""",
    "v_titles": """
        select record_number, string_agg(token,' ' order by pos) as title
        from v_tagged group by record_number""",
    "v_plain": """
        select record_number, pos, token, row_idx, last_value(tag ignore nulls) over (
            order by row_idx rows between unbounded preceding and current row) as tag
        from v_tagged""",
    "v_filled": """
        select record_number, pos, row_idx, token,
               case when tag is not null then tag when c is null then null
                    when c in ('No Tag','Obscure') then c else concat(c,'-I') end as tag
        from (select record_number, pos, row_idx, token, tag, last_value(tag ignore nulls) over (
                order by row_idx rows between unbounded preceding and current row) as c
              from v_tagged) t""",
    "v_gold": """
        select record_number, pos, token, tag, label_id as y
        from v_filled join dim on tag = label""",
    "v_pred": """
        select record_number, pos, token, y,
               case (record_number*7+pos*3)%10 when 0 then 0 when 1 then (y+1)%70 else y end as p
        from v_gold""",
    "v_logits": """
        select record_number, pos, m as model_id,
               case c when 0 then y when 1 then (y+1)%70 else (y+35)%70 end as label_id,
               cast((record_number*31+pos*17+m*7+c*13)%11 as double)/4
                 + case when c=0 then 1.0 else 0.0 end as logit
        from v_gold cross join (values (0),(1),(2),(3),(4),(5)) a(m)
                    cross join (values (0),(1),(2)) b(c)""",
    "v_probs": """
        select record_number, pos, model_id, label_id, exp(logit-mx)/sum(exp(logit-mx))
                 over (partition by record_number,pos,model_id) as prob
        from (select *, max(logit) over (partition by record_number,pos,model_id) as mx
              from v_logits) t""",
    "v_mean": """
        select record_number, pos, label_id, round(sum(prob)/6, 9) as prob
        from v_probs group by all""",
    "v_best": """
        select record_number, pos, label_id from v_mean
        qualify row_number() over (partition by record_number, pos
                                   order by prob desc, label_id) = 1""",
    "v_report": """
        select label_id, support, predicted, tp,
               case when predicted=0 then 0 else tp/predicted::double end as precision,
               case when support=0 then 0 else tp/support::double end as recall,
               case when support+predicted=0 then 0
                    else 2*tp/(support+predicted)::double end as f1
        from (select label_id, sum(s)::bigint as support, sum(q)::bigint as predicted,
                     sum(t)::bigint as tp
              from (select y as label_id, 1 as s, 0 as q, 0 as t from v_pred
                    union all select p, 0, 1, (y=p)::int from v_pred) u
              group by label_id) c""",
    "v_pieces": """
        select record_number, pos, token, tag, y, i-1 as piece_no,
               ('0x' || substr(md5(ps[i]),1,4))::int + 3 as piece_id
        from (select *, regexp_extract_all(token, '.{1,4}') as ps from v_gold) w,
             lateral (select unnest(range(1, len(ps)+1))::int as i) r""",
    "v_part_words": """
        select distinct w from (select unnest(string_split(
            concat_ws(' ', p_name, p_brand, p_type, p_size::varchar), ' ')) as w from part) t
        where w <> ''""",
    "v_vocabulary": """
        select piece, (row_number() over (order by piece) + 2)::int as piece_id
        from (select left(w, n) as piece
              from v_part_words cross join (values (1), (2), (3), (4), (5)) k(n)
              union
              select '##' || substr(w, spot, n)
              from (select w, unnest(range(2, length(w) + 1)) as spot from v_part_words) p
              cross join (values (1), (2), (3)) k(n)) t
        where not contains(piece, '7')""",
    "v_aligned": """
        select record_number,
               [0] || list(piece_id order by pos, piece_no) || [2] as ids,
               [null] || list(case when piece_no=0 then y end order by pos, piece_no)
                 || [null] as labels
        from v_pieces group by record_number""",
    "v_shuffled": """
        select *, (row_number() over (order by md5('42:' || record_number), record_number) - 1)
                  as n from v_titles""",
    "v_padded": """
        select record_number, batch_id, slot, list_resize(ids, mx, 1) as ids,
               list_resize(labels, mx, null) as labels
        from (select a.*, n//32 as batch_id, (n%32)::int as slot,
                     max(len(ids)) over (partition by n//32) as mx
              from v_aligned a join v_shuffled using (record_number)) t""",
    "v_epochs": """
        select record_number%5 as fold, epoch, y,
               case (record_number*(epoch+7)+pos*3)%10 when 0 then 0 when 1 then (y+1)%70
                    else y end as p
        from v_gold cross join (values (0),(1),(2),(3),(4)) e(epoch)""",
    "v_scores": """
        select fold::int as fold, epoch, round(sum(f1*support)/sum(support), 6) as f1
        from (select fold, epoch, label_id, sum(s) as support,
                     2*sum(t)/(sum(s)+sum(q))::double as f1
              from (select fold, epoch, y as label_id, 1 as s, 0 as q, 0 as t from v_epochs
                    union all select fold, epoch, p, 0, 1, (y=p)::int from v_epochs) u
              where label_id >= 2 group by fold, epoch, label_id) c
        group by fold, epoch""",
    "v_doc": """
        select d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic
        from documents d left join labels l on d.doc_id = l.doc_id""",
}


def _fold_views(gold: str, suffix: str = "") -> dict[str, str]:
    """Labels per record, rarity, folds and their distribution of a labelled word table."""
    wanted = ", ".join(f"'{t}'" for t in TAGS_OF_INTEREST)
    reclab, rarity, folds = (f"v_{name}{suffix}" for name in ("reclab", "rarity", "folds"))
    return {
        reclab: f"""
            select record_number, y as label_id, count(*) as n_words from {gold} group by all""",
        rarity: f"""
            select label_id, n_records,
                   (row_number() over (order by n_records, label_id) - 1)::int as rarity
            from (select label_id, count(*) as n_records from {reclab} group by label_id) t""",
        folds: f"""
            select record_number, stratum, ((row_number() over (partition by stratum
                     order by md5('42:' || record_number), record_number) - 1) % 5)::int as fold
            from (select record_number, min(rarity) as stratum
                  from {reclab} join {rarity} using (label_id) group by record_number) t""",
        f"v_dist{suffix}": f"""
            select fold, label_id,
                   (sum(n_test) over (partition by label_id) - n_test)::bigint as n_train,
                   n_test::bigint as n_test
            from (select f.fold, d.label_id, coalesce(sum(n_words), 0)::bigint as n_test
                  from (select unnest(range(0, 5))::int as fold) f
                  cross join (select label_id from dim where label in ({wanted})) d
                  left join (select fold, label_id, n_words from {folds}
                             join {reclab} using (record_number)) w
                    on w.fold = f.fold and w.label_id = d.label_id
                  group by f.fold, d.label_id) t""",
    }


VIEWS |= _fold_views("v_gold")
VIEWS["v_plain_gold"] = """
    select record_number, pos, token, tag, label_id as y
    from v_plain join dim on tag = label"""
VIEWS |= _fold_views("v_plain_gold", "_plain")


def _spans(words: str) -> str:
    """Spans of a relation (record_number, pos, token, label)."""
    return f"""
        select record_number, span_no::bigint as span_no,
               regexp_replace(arg_min(label, pos), '-I$', '') as aspect,
               string_agg(token, ' ' order by pos) as value
        from (select *, sum(begins) over (partition by record_number order by pos) as span_no
              from (select *, case when label not like '%-I' or row_number() over (
                                partition by record_number order by pos) = 1
                              then 1 else 0 end as begins
                    from ({words}) w where label not in ('No Tag', 'Obscure')) k) s
        group by record_number, span_no"""


def _lines(spans: str) -> str:
    return f"""
        select row_number() over (order by record_number, span_no) as line_no,
               record_number || chr(9) || aspect || chr(9) || value as line
        from {spans}"""


VIEWS["v_spans"] = _spans(
    "select record_number, pos, token, tag as label from v_filled where tag is not null"
)
VIEWS["v_pspans"] = _spans(
    "select record_number, pos, token, label from v_pred join dim on p = label_id"
)
VIEWS["v_diff"] = f"""
    select coalesce(a.line_no, b.line_no) as line_no, a.line as line_a, b.line as line_b
    from ({_lines("v_spans")}) a full outer join ({_lines("v_pspans")}) b
      on a.line_no = b.line_no
    where a.line is distinct from b.line"""


def _used(sql: str, found: set[str]) -> set[str]:
    for name, body in VIEWS.items():
        if name not in found and _mentions(sql, name):
            found.add(name)
            _used(body, found)
    return found


def _mentions(sql: str, name: str) -> bool:
    words = sql.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return name in words


def with_views(sql: str) -> str:
    """Put the derived tables a statement needs in front of it."""
    used = _used(sql, set())
    ctes = ", ".join(f"{n} as ({body})" for n, body in VIEWS.items() if n in used)
    return f"with {ctes} {sql}" if ctes else sql


_TEXT = "array_to_string(list_transform({0}, lambda x: coalesce(x::varchar, '-')), ' ')"


def _text(column: str) -> str:
    return f"{_TEXT.format(column)} as {column}"


_PER_LABEL = "count(*) as n, round(sum(prob), 4) as total"
_TITLE = "join v_titles using (record_number)"

def _greedy(words: str) -> str:
    """Piece ids of the words of a relation (token), by a walk over the longest matches."""
    return f"""
        with recursive distinct_words as (select distinct token from ({words}) d),
        places as (
            select token, unnest(range(1, length(token) + 1)) as spot from distinct_words),
        parts as (
            select token, spot, n, case when spot > 1 then '##' else '' end || substr(token, spot, n)
                     as piece
            from places cross join (values (1), (2), (3), (4), (5)) k(n)
            where spot + n - 1 <= length(token)),
        longest as (
            select token, spot, max(n) as n, arg_max(piece_id, n) as piece_id
            from parts join v_vocabulary using (piece) group by token, spot),
        walk as (
            select token, 1::bigint as spot, ''::varchar as ids from distinct_words
            union all
            select w.token, w.spot + n, w.ids || case when w.spot > 1 then ' ' else '' end || piece_id
            from walk w join longest l on w.token = l.token and w.spot = l.spot)
        select token, coalesce(max(ids) filter (spot > length(token)), '2') as piece_ids
        from walk group by token"""


VIEWS |= {
    "v_numbered": """
        select record_number, row_number() over (order by record_number) - 1 as number,
               count(*) over () as n
        from v_titles where record_number > 120000""",
    "v_permuted": """
        with recursive keys as (
            select pass_no, r, ('0x' || substr(d, 1, 12))::bigint as k,
                   ('0x' || substr(d, 13, 7))::bigint + 1 as factor,
                   ('0x' || substr(d, 20, 7))::bigint as shift
            from (select pass_no, r, md5((42 + pass_no) || ':' || r) as d
                  from (select unnest(range(0, 3)) as pass_no) p
                  cross join (select unnest(range(0, 32)) as r) q) t),
        walk as (
            select record_number, n, pass_no, 0::bigint as r, number as spot
            from v_numbered cross join (select unnest(range(0, 3)) as pass_no) p
            union all
            select record_number, n, pass_no, r + 1,
                   case when ((greatest(spot, partner) % 2147483647 * factor + shift)
                              % 2147483647) // 65536 % 2 = 1 then partner else spot end
            from (select w.*, (k - spot + n) % n as partner, factor, shift
                  from walk w join keys using (pass_no, r)) t)
        select record_number, n, pass_no, spot from walk where r = 32""",
    "v_greedy": _greedy("select token from v_gold"),
    "v_greedy_pieces": """
        select record_number, pos, y, i - 1 as piece_no, string_split(piece_ids, ' ')[i]::int as piece_id
        from (select * from v_gold join v_greedy using (token)) w,
             lateral (select unnest(range(1, len(string_split(piece_ids, ' ')) + 1))::int as i) r""",
    "v_document_words": """
        select unnest(list_filter(string_split_regex(text, '[\\s\\v\\x1c-\\x1f\\x85\\p{Z}]+'),
                                  lambda x: x <> '')) as token from documents""",
    "v_greedy_documents": _greedy("select token from v_document_words"),
    "v_greedy_aligned": """
        select record_number,
               [0] || list(piece_id order by pos, piece_no) || [2] as ids,
               [null] || list(case when piece_no=0 then y end order by pos, piece_no)
                 || [null] as labels
        from v_greedy_pieces group by record_number""",
}

STATEMENTS = {
    "vocabulary_table": "select * from v_vocabulary",
    "vocabulary_pieces": """
        select record_number, pos, token, piece_ids from v_gold join v_greedy using (token)""",
    "vocabulary_document_words": """
        select token, n, piece_ids from v_greedy_documents
        join (select token, count(*) as n from v_document_words group by token) c using (token)""",
    "align_vocabulary_words": """
        select record_number, pos, piece_no, piece_id, case when piece_no=0 then y end as label_id
        from v_greedy_pieces""",
    "align_vocabulary_sequences": f"""
        select record_number, {_text("ids")}, {_text("labels")} from v_greedy_aligned""",
    "read_tagged_file": f"""
        select record_number, title, token, tag, row_number() over (order by row_idx) - 1
               as row_idx from v_tagged {_TITLE}""",
    "read_titles_file": """
        select *, row_number() over (order by record_number) - 1 as row_idx from v_titles""",
    "read_unlabeled_file": "select * from v_titles where record_number > 120000",
    "read_output_lines": _lines("v_spans"),
    "write_spans_file": "select record_number, aspect, value from v_spans",
    "head_rows": "select * from v_tagged order by row_idx limit 16",
    "count_rows": "select count(*) as n from v_tagged",
    "project_words": "select record_number, token, tag from v_tagged",
    "records_above": "select * from v_titles where record_number > 120000",
    "labelled_positions": """
        select record_number, pos, piece_no, y from v_pieces where piece_no = 0""",
    "aspect_word_rows": """
        select record_number, pos, token, tag as label from v_filled
        where tag not in ('No Tag', 'Obscure')""",
    "label_dictionary": """
        select label_id, label, base, is_inner, english, count(y) as n
        from dim left join v_gold on y = label_id group by all""",
    "label_to_id": "select record_number, pos, y as label_id from v_gold",
    "id_to_label": "select record_number, pos, label from v_pred join dim on p = label_id",
    "english_names": """
        select tag, english, count(*) as n from v_plain left join dim on tag = label
        where tag is not null group by all""",
    "inner_labels": """
        select record_number, pos, (tag like '%-I')::int as is_inner,
               regexp_replace(tag, '-I$', '') as base,
               case when tag in ('No Tag','Obscure') then tag
                    else regexp_replace(tag, '-I$', '') || '-I' end as continued
        from v_filled where tag is not null""",
    "split_title_words": """
        select record_number, (i-1)::int as pos, words[i] as token
        from (select record_number, string_split_regex(title, '\\s+') as words from v_titles) w,
             lateral (select unnest(range(1, len(words)+1)) as i) r""",
    "split_document_words": """
        select lang, count(*) as n_words, sum(length(words[i]))::bigint as n_letters,
               max(i-1)::bigint as last_pos, count(distinct words[i]) as n_distinct
        from (select lang, list_filter(string_split_regex(text, '[\\s\\v\\x1c-\\x1f\\x85\\p{Z}]+'),
                                       lambda x: x <> '') as words from documents) w,
             lateral (select unnest(range(1, len(words)+1)) as i) r
        group by lang""",
    "fill_plain": "select record_number, pos, token, tag, row_idx from v_plain",
    "fill_inner": "select * from v_filled",
    "fill_small_chunks": "select * from v_filled",
    "fill_sparse_order": "select * replace (row_idx * 256 as row_idx) from v_filled",
    "fill_hashed_order": """
        select record_number, pos, row_idx, token,
               case when tag is not null then tag when c is null then null
                    when c in ('No Tag','Obscure') then c else concat(c,'-I') end as tag
        from (select *, last_value(tag ignore nulls) over (order by row_idx
                rows between unbounded preceding and current row) as c
              from (select * replace (row_idx * 2654435761 % 4294967291 as row_idx)
                    from v_tagged) h) t""",
    "fill_chunk_sizes": """
        select name, count(*) as n_words, 1 as few, 1 as even
        from v_tagged cross join (values ('plain'), ('sparse'), ('hashed')) n(name)
        group by name""",
    "fill_within_record": """
        select record_number, pos, row_idx, token,
               case when tag is not null then tag when c in ('No Tag','Obscure') then c
                    else c || '-I' end as tag
        from (select *, last_value(tag ignore nulls) over (partition by record_number
                order by row_idx rows between unbounded preceding and current row) as c
              from v_tagged) t""",
    "first_titles": f"""
        select record_number, arg_min(title, row_idx) as title
        from v_tagged {_TITLE} group by record_number""",
    "dense_positions": """
        select record_number, row_idx, row_number() over (
            partition by record_number order by row_idx) - 1 as pos from v_tagged""",
    "neighbour_words": """
        select record_number, pos, lag(token) over w as prev, lead(token) over w as next
        from v_tagged window w as (partition by record_number order by pos)""",
    "span_decode": "select * from v_spans",
    "span_decode_predicted": "select * from v_pspans",
    "best_epochs": """
        select fold, epoch, f1, (f1 > coalesce(max(f1) over (partition by fold order by epoch
                 rows between unbounded preceding and 1 preceding), 0))::int as is_best
        from v_scores""",
    "best_epoch_per_fold": """
        select fold, epoch, f1 from v_scores
        qualify row_number() over (partition by fold order by f1 desc, epoch) = 1""",
    "word_sequences": """
        select record_number, 0 as part,
               string_agg(token || '/' || coalesce(tag, ''), ' ' order by pos) as seq
        from v_filled group by record_number""",
    "token_tag_pairs": "select record_number, pos, token, tag from v_filled",
    "tag_frequency": """
        select tag, count(*) as n from v_filled where tag is not null group by tag""",
    "distinct_tags": """
        select record_number, string_agg(coalesce(tag, '-'), ',' order by f) as tags
        from (select record_number, tag, min(row_idx) as f from v_plain group by all) t
        group by record_number""",
    "tag_index": """
        select tag, first_idx, row_number() over (order by first_idx) - 1 as tag_no
        from (select tag, min(row_idx) as first_idx from v_plain group by tag) t""",
    "multi_hot": """
        select record_number, array_to_string([case when list_contains(ys, i) then '1' else '0' end
                 for i in range(0, 70)], '') as hot
        from (select record_number, list(distinct y) as ys from v_gold group by all) t""",
    "multi_hot_columns": """
        select record_number, """
    + ", ".join(
        f"""max(coalesce(tag='{t}', false)::int) as "{t}" """
        for t in ("Marke", "Farbe", "Modell", "Produktart", "No Tag", "EU-Schuhgröße")
    )
    + """ from v_plain group by record_number""",
    "sequence_check": """
        select record_number, n_words, n_tags, n_labelled,
               case when n_words <> n_tags then 'words and tags differ'
                    when n_labelled <> n_tags then 'words without a tag' end as problem
        from (select record_number, len(string_split(title, ' ')) as n_words from v_titles) t
        join (select record_number, count(*) as n_tags, count(tag) as n_labelled
              from v_filled where token <> 'EU' group by record_number) w
          using (record_number)""",
    "confusion_table": "select y, p, count(*) as n from v_pred group by all",
    "class_report": """
        select label_id, support, predicted, tp, round(precision, 6) as precision,
               round(recall, 6) as recall, round(f1, 6) as f1 from v_report""",
    "f1_weighted": "select round(sum(f1*support)/sum(support), 6) as f1 from v_report",
    "f1_macro": "select round(avg(f1), 6) as f1 from v_report",
    "f1_micro": "select round(sum(tp)/sum(support), 6) as f1 from v_report",
    "f1_aspects": """
        select round(sum(f1*support)/sum(support), 6) as f1 from v_report where label_id >= 2""",
    "class_weights": """
        select y as label_id, count(*) as support,
               round(count(*) / sum(count(*)) over (), 6) as weight
        from v_gold where y >= 2 group by y""",
    "softmax_rows": f"select model_id, label_id, {_PER_LABEL} from v_probs group by all",
    "softmax_arrays": f"select model_id, label_id, {_PER_LABEL} from v_probs group by all",
    "ensemble_mean": f"select label_id, {_PER_LABEL} from v_mean group by all",
    "ensemble_label": "select * from v_best",
    "argmax_arrays": """
        select record_number, pos, (list_position(s, list_max(s)) - 1)::int as best
        from (select record_number, pos, [(y*3+pos*i)%5 for i in range(0, 6)] as s
              from v_gold) t""",
    "ensemble_spans": _spans("""
        select record_number, pos, token, label from v_tagged
        join v_best using (record_number, pos) join dim using (label_id)"""),
    "pair_predictions": "select record_number, pos, y, p from v_pred",
    "first_piece_predictions": "select record_number, pos, token, p as label_id from v_pred",
    "line_diff": "select * from v_diff",
    "diff_summary": """
        select count(*) as differences,
               count_if(line_a is null or line_b is null)::bigint as length_difference,
               min(line_no) as first_line, (count(*) = 0)::int as identical from v_diff""",
    "word_pieces": """
        select record_number, pos, token, array_to_string(
            [(('0x' || substr(md5(x),1,4))::int + 3)::varchar
             for x in regexp_extract_all(token, '.{1,4}')], ' ') as piece_ids
        from v_tagged""",
    "word_pieces_plugin": """
        select record_number, pos, token, array_to_string(
            [unicode(x)::varchar for x in regexp_extract_all(token, '.{1,3}')], ' ') as piece_ids
        from v_tagged""",
    "align_words": """
        select record_number, pos, piece_no, piece_id, case when piece_no=0 then y end as label_id
        from v_pieces""",
    "align_sequences": f"""
        select record_number, {_text("ids")}, {_text("labels")} from v_aligned""",
    "unalign_pieces": """
        select record_number, pos, piece_id, tag as label from v_pieces where piece_no = 0""",
    "truncate_sequences": f"""
        select record_number, {_text("ids")}, {_text("labels")}
        from (select record_number,
                case when len(ids) > 12 then ids[1:11] || [2] else ids end as ids,
                case when len(ids) > 12 then labels[1:11] || [null] else labels end as labels
              from v_aligned) t""",
    "shuffle_order": """
        select record_number, md5('42:' || record_number) as shuffle_key from v_titles""",
    "batches_in_order": """
        select record_number, n//32 as batch_id, (n%32)::int as slot
        from (select record_number, row_number() over (order by record_number) - 1 as n
              from v_titles) t""",
    "batches_shuffled": """
        select record_number, n//32 as batch_id, (n%32)::int as slot from v_shuffled""",
    "pad_batches": f"""
        select record_number, batch_id, slot, {_text("ids")}, {_text("labels")},
               array_to_string([(x <> 1)::int::varchar for x in ids], ' ') as mask
        from v_padded""",
    "mask_predictions": """
        select record_number, array_to_string(list_transform(ids, lambda x, i:
                 case when i > 1 and x <> 2 and x <> 1 then ((x+i-1)%70)::varchar else '-' end),
                 ' ') as preds
        from v_padded""",
    "cycle_batches": """
        select record_number, pass_no, pass_no*nb + n//32 as step, (n%32)::int as slot
        from (select record_number, pass_no, nb, row_number() over (partition by pass_no
                order by md5((42+pass_no) || ':' || record_number), record_number) - 1 as n
              from v_titles
              cross join (select unnest(range(0, 3)) as pass_no) p
              cross join (select (count(*)+31)//32 as nb from v_titles
                          where record_number > 120000) c
              where record_number > 120000) t
        where pass_no*nb + n//32 < nb*5//2""",
    "cycle_permuted": """
        select record_number, pass_no, pass_no*((n+31)//32) + spot//32 as step,
               (spot%32)::int as slot
        from v_permuted where pass_no*((n+31)//32) + spot//32 < (n+31)//32*5//2""",
    "stratified_folds": "select * from v_folds",
    "label_rarity": "select * from v_rarity",
    "split_fold_rows": """
        select case when fold = 0 then 'test' else 'train' end as side, fold,
               count(*) as n_words, sum(y)::bigint as sum_y
        from v_gold join v_folds using (record_number) group by all""",
    "test_fold_words": """
        select record_number, pos, token, y from v_gold join v_folds using (record_number)
        where fold = 2""",
    "fold_distribution": """
        select fold, label, n_train, n_test from v_dist join dim using (label_id)""",
    "fold_balance": """
        select label_id, min(n_test) as min_test, max(n_test) as max_test,
               round(max(abs(n_test*5/(n_test+n_train) - 1)), 6) as max_deviation
        from v_dist where n_test + n_train > 0 group by label_id""",
    "document_folds": """
        select doc_id, stratum, ((row_number() over (partition by stratum
                 order by md5('42:' || doc_id), doc_id) - 1) % 5)::int as fold
        from (select doc_id, min(rarity) as stratum
              from (select doc_id, quality as m from v_doc where quality is not null
                    union all select doc_id, toxic+2 from v_doc where quality is not null) x
              join (select m, (row_number() over (order by count(*), m) - 1)::int as rarity
                    from (select quality as m from v_doc where quality is not null
                          union all select toxic+2 from v_doc where quality is not null) z
                    group by m) y using (m)
              group by doc_id) t""",
    "unlabelled_documents": """
        select lang, source, count(*) as n from v_doc where quality is null group by all""",
}

# What is certain of fitted models and of folds that are not unique.
STATEMENTS |= {
    "fold_distribution_plain": """
        select fold, label, n_train, n_test from v_dist_plain join dim using (label_id)""",
    "best_label_logits": """
        select record_number, pos, label_id
        from (select record_number, pos, label_id, round(sum(logit - 6)/6, 9) as score
              from v_logits group by all) t
        qualify row_number() over (partition by record_number, pos
                                   order by score desc, label_id) = 1""",
    "f1_without_aspects": "select cast(null as double) as f1",
    "prediction_check": """
        select record_number, count(y) as n_truth, count(p) as n_predicted,
               count_if(y is null or p is null)::bigint as n_unpaired,
               case when count_if(p is null) > 0 then 'positions without a prediction'
                    when count_if(y is null) > 0 then 'predictions left over' end as problem
        from (select record_number, pos, y, case when record_number % 7 = 0 and pos = 3
                       then null else p end as p from v_pred
              union all
              select record_number, 99, null, 0 from v_pred
              where record_number % 5 = 0 and pos = 4) t
        group by record_number""",
    "piece_check": """
        select record_number, count(*) as n_words,
               count_if(regexp_replace(token, '[^A-Za-z]', '', 'g') = '')::bigint as n_without
        from v_tagged group by record_number""",
    "pseudo_labels_all_pieces": """
        select record_number, '- ' || string_agg(p::varchar, ' ' order by pos, piece_no) || ' -'
                 as preds
        from (select record_number, pos, piece_no from v_pieces) x
        join (select record_number, pos, p from v_pred) y using (record_number, pos)
        group by record_number""",
    "tagger_evaluation_support": """
        select y as label_id, count(*) as support from v_gold join v_folds using (record_number)
        where fold = 0 group by y""",
    "tagger_cross_validation_better": """
        select fold, round, 1 as better from (select unnest(range(0, 5))::int as fold) f
        cross join (select unnest(range(0, 2))::int as round) r""",
    "saved_tagger_agreement": """
        select count(*) as n_words, count(*) as n_agree
        from v_gold join v_folds using (record_number) where fold = 0""",
    "infer_titles_word_balance": """
        select count(*) as n_titles, 0::bigint as difference from v_titles""",
    "infer_titles_ensemble_word_balance": """
        select count(*) as n_titles, 0::bigint as difference from v_titles""",
    "pseudo_label_words": """
        select record_number, (i-1)::int as pos, words[i] as token, 1 as in_range
        from (select record_number, string_split_regex(title, '\\s+') as words from v_titles
              where record_number > 120000) w,
             lateral (select unnest(range(1, len(words)+1)) as i) r""",
    "self_training_rounds": """
        select round, case when round = 0 then 0 else n end::bigint as n_pseudo
        from (select unnest(range(0, 3))::int as round) r
        cross join (select sum(len(string_split_regex(title, '\\s+'))) as n from v_titles
                    where record_number > 120000) w""",
    "quota_folds_once": """
        select record_number, 1 as n_folds, 1 as in_range from v_reclab group by record_number""",
    "quota_fold_label_sets": """
        select labels, count(*) as n_records, 1 as is_even
        from (select record_number, string_agg(label_id::varchar, ' ' order by label_id) as labels
              from (select distinct record_number, label_id from v_reclab) x group by 1) y
        group by labels""",
    "quota_fold_totals": """
        select label_id, n_records, 1 as is_even from v_rarity""",
}

ORACLE = {name: with_views(sql) for name, sql in STATEMENTS.items()}
