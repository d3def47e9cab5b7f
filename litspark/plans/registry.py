"""All registered queries outside the training-data package."""

from litspark.plans import catalog, figures, indexing, layout, library, notes, retrieval, runs, scholarly, sections, streams, texts, vectors, works

QUERIES: dict = {}
ORACLE: dict = {}
for module in (library, vectors, retrieval, notes, runs, works, texts, sections, figures, catalog, indexing, scholarly, layout, streams):
    QUERIES |= {name: run for name, (run, _) in module.REGISTERED.items()}
    ORACLE |= {name: sql for name, (_, sql) in module.REGISTERED.items() if sql}
