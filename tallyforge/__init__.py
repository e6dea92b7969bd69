"""Analytics on PySpark for catalogues, holdings, event sequences and contests."""
