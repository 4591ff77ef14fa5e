"""SQL of the entity tables of ``sources.tables``, as common table expressions."""

from __future__ import annotations

PACKS_SQL = """packs as (
  select o_orderkey as pack_id, 'src' || o_orderkey % 20 as user_id, 'pack ' || o_orderkey as title, ids, '[' || array_to_string(ids, ',') || ']' as source_file_ids,
         o_custkey % 12 as cluster_id, o_orderkey % 9 = 0 as is_locked
  from orders join (select l_orderkey, list_sort(list_distinct(list(l_partkey))) as ids from lineitem group by 1) on l_orderkey = o_orderkey)"""
CHATS_SQL = "chats as (select conv_id as chat_id, 'src' || conv_id % 20 as user_id, text as question, [conv_id * 3 % 1500, conv_id * 7 % 1500] as ids from conversations where turn = 0)"
NODES_SQL = """nodes as (
  select node, case left(node, 1) when 'o' then 'source_file' when 'p' then 'entity' else 'project' end as object_type,
         case when node like 'o%' then 'file' when node like 'p%' then case when substr(node, 2)::bigint % 5 <> 0 then 'entity' end else 'project' end as family,
         case left(node, 1) when 'o' then 'order ' when 'p' then 'part ' else 'supplier ' end || substr(node, 2) as label
  from (select source as node from edges union select target from edges))"""
SUGGESTIONS_SQL = """suggestions as (
  select event_id as suggestion_id, 'src' || event_id % 20 as user_id, 'o' || event_id % 700 as source, 'p' || event_id * 7 % 900 as target,
         case when event_type in ('view', 'click') then 'pending' when event_type = 'purchase' then 'accepted' else 'dismissed' end as status from events)"""
TOKENS_SQL = """tokens as (
  select c_custkey as token_id, 'src' || c_custkey % 20 as user_id, sha256('token ' || c_custkey) as token_hash, case when c_custkey % 7 = 0 then timestamp '2024-01-20' end as revoked_at from customer)"""
