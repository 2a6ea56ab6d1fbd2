"""quillflow: document import pipelines (detect, parse, filter, tag, transform, split) as Spark DataFrame plans."""
