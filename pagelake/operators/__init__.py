"""DataFrame -> DataFrame operators on tables of pages, regions, lines and detections."""
