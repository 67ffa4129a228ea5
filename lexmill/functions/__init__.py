"""Column functions: text extraction and cleaning, chat messages, number formats, learning-rate schedules."""
