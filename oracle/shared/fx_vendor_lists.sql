SELECT o.offer_id, CAST(len(o.vendor_descriptions) AS INT) AS vendor_count, CAST(to_json(o.articles) AS VARCHAR) AS articles, CAST(to_json(o.vendor_ids) AS VARCHAR) AS vendor_ids,
  CAST(to_json(o.vendor_descriptions) AS VARCHAR) AS vendor_descriptions
FROM (SELECT r.offer_id, list_sort(list(DISTINCT r.article_id)) AS articles, list_sort(list(DISTINCT v.vendor_id), 'ASC', 'NULLS FIRST') AS vendor_ids,
        list_sort(list(DISTINCT coalesce(v.vendor_description, '0'))) AS vendor_descriptions
      FROM (SELECT DISTINCT offer_id, article_id FROM fx_reward WHERE offer_id IN (SELECT offer_id FROM fx_offer)) r
      LEFT JOIN fx_article_vendor v ON v.article_id = r.article_id GROUP BY r.offer_id) o
