"""Reading uploads and storing tables and exports."""
