"""Reading and writing tables, pages, metrics documents and gazetteers."""
