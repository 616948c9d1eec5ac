"""tickerloom: a PySpark analytics engine for financial-news intelligence."""
