"""The composed tables, built from operators: snapshot, report tables, pages, and a whole run."""
