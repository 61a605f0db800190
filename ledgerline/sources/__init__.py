"""Raw export, derived export and the shared folder for written tables."""
