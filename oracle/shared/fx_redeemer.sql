SELECT DISTINCT r.offer_id, b.brand, r.scv_id FROM fx_redeemed r JOIN fx_brand_article b ON b.offer_id = r.offer_id AND b.article_id = r.article_id
