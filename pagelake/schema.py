"""Tables, as DDL. Texts are '' rather than null, confidences 0; every order is a column of its own."""

BBOX = "struct<x0:int,y0:int,x1:int,y1:int>"
PAGES = "page_id bigint, path string, width int, height int"
REGIONS = "page_id bigint, region_idx int, label string, x0 int, y0 int, x1 int, y1 int, text string, confidence double"
LINES = "page_id bigint, region_idx int, line_idx int, x0 int, y0 int, x1 int, y1 int, text string, confidence double"
DICTIONARY = "term string, count bigint"
