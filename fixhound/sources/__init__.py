"""Tables in, reports and sheets out."""
