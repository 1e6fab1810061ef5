"""SQL for DuckDB that gives the rows of those queries that SQL can express."""

ORACLE = {
    "op7_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) score
      from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank from s)
select query_id, rank, vec_id, score from r where rank <= 20""",
    "op8_mix_sources": """
with d as (select doc_id, source, coalesce(text, '') t from documents),
k as (select doc_id, source, cast(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) as bigint) size, md5(t) digest,
      -ln((cast(cast('0x' || substr(md5('8:' || cast(doc_id as varchar)), 1, 12) as bigint) as double) + 0.5) / 281474976710656.0)
      / greatest(0.1, 1 - 8 * (length(t) - length(translate(t, '#*$%&|<>!', ''))) / greatest(length(t), 1)) key from d),
z as (select source, sum(size)::bigint source_size from k group by source),
w as (select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3]::double w, 3.0 * source_size as_full from z),
f as (select *, row_number() over (order by as_full / w, source nulls last) place, sum(source_size::double) over () total,
      coalesce(sum(as_full) over (order by as_full / w, source nulls last rows between unbounded preceding and 1 preceding), 0) filled,
      sum(w) over (order by as_full / w, source nulls last rows between current row and unbounded following) open_w from w),
l as (select min_by((total - filled) / open_w, place) level from f where (total - filled) / open_w * w < as_full),
t as (select source, source_size, least(as_full, coalesce((select level from l) * w, as_full)) target from f),
r as (select k.*, source_size, target, case when source_size > 0 then floor(target / source_size)::bigint else 0 end epochs,
      sum(size) over (partition by k.source order by key, doc_id nulls last, size, digest rows between unbounded preceding and current row) upto
      from k join t on k.source is not distinct from t.source)
select doc_id, size, source_size, target,
  cast((epochs + case when size > 0 and upto - size / 2.0 <= target - epochs * source_size then 1 else 0 end) * size as bigint) taken from r""",
    "op10_warc": """
with p as (select page_id, coalesce(html, '') h from pages),
q as (select page_id, cast(octet_length(encode(h)) as bigint) b, sha256(h) d from p),
f as (select d, min(page_id) first from q where b >= 100 group by d)
select page_id, b payload_bytes, q.d payload_digest, case when b >= 100 and page_id <> first then 'revisit' else 'response' end record_type,
  case when b >= 100 and page_id <> first then first end refers_to from q left join f on q.d = f.d""",
}
