/*@ {
  "params": {"max_key": "long"},
  "nest": {
    "key": "id",
    "order": ["id", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    "fields": [
      {"name": "nation", "mapping": "per_row", "columns": {"name": "n_name", "region": "r_name"}},
      {"name": "orders", "mapping": "collection", "key": "o_orderkey",
       "columns": {"key": "o_orderkey", "status": "o_orderstatus", "price": "o_totalprice"},
       "children": [
         {"name": "lines", "mapping": "collection",
          "columns": {"number": "l_linenumber", "part": "l_partkey", "supplier": "l_suppkey", "quantity": "l_quantity"}}
       ]}
    ]
  }
} */
SELECT c.c_custkey AS id, c.c_name AS name, c.c_mktsegment AS segment,
       n.n_name, r.r_name,
       o.o_orderkey, o.o_orderstatus, o.o_totalprice,
       l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity
FROM customer c
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN orders o ON o.o_custkey = c.c_custkey
LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE c.c_custkey <= :max_key
