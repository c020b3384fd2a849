"""Table readers and text extraction into the shared page and document schemas."""
