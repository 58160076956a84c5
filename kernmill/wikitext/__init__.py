"""Wiki markup: templates and parser functions, cleaning, paragraphs and links."""
