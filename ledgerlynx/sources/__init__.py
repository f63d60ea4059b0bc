"""Where invoices come from and where results go."""
