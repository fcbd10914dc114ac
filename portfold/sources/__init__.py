"""Where tables come from and go to: CSV files and the month-partitioned store."""
