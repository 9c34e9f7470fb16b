SELECT scv_id, round(non_fuel_sales, 4) AS non_fuel_sales FROM fx_reference_sales
